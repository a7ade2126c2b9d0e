import sys

import pyarrow as pa
import pytest

from velloom.llm import token_counts, tokenizing


def test_each_digest_once_beyond_a_million():
    digests = [b"%07d" % (i // 2) for i in range(2_400_001)]
    batches = [pa.record_batch([pa.array(digests[i : i + 9999])], names=["digest"]) for i in range(0, len(digests), 9999)]
    got = [d for b in token_counts._runs(iter(batches)) for d in b.column(0).to_pylist()]
    assert got == sorted(set(digests))


def test_copies_from_many_tasks(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id doc_id", "concat('text ', id % 50) text").repartition(16)
    cache = f"{tmp_path}/cache"
    assert token_counts.token_counts(docs, cache).count() == 4000 and token_counts.token_counts(docs, cache).count() == 4000
    assert spark.read.parquet(cache).count() == 50


def test_counts_whatever_the_room():
    path = tokenizing.vocabulary("byte_bpe_50k.json")
    texts = ["", " \t ", "a  b\n\nc", "<|endoftext|> x<|", "x" * 70 + " y", "漢字" * 40 + " ü é", "it's 12345 , x ", *(f"word{i} word{i % 7}" for i in range(600))] * 2
    library = tokenizing.Encoder(path, False).tokenizer
    wanted = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for room in (0, 3000, tokenizing.ROOM):
        code = tokenizing.Counter(path, room)
        for _ in range(2):
            assert code.counts([t.encode() for t in texts]) == wanted
        assert sum(sys.getsizeof(s) for s in code.memo) <= room and not code.memo.rare


@pytest.fixture
def one_partition(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    yield
    spark.conf.set(name, before)


def test_worker_memory_with_many_long_stretches(spark, tmp_path, one_partition):
    """150 000 stretches of 61 characters are far below a million stretches; their ids would take more than the room in bytes."""
    long = "concat_ws(' ', transform(sequence(0, 99), i -> substring(translate(sha2(concat(id, '-', i), 256), '0123456789abcdef', '天地玄黃宇宙洪荒日月盈昃辰宿列張'), 1, 60)))"
    docs = spark.range(0, 1500, 1, 1).selectExpr("id doc_id", f"{long} text")
    assert token_counts.token_counts(docs, f"{tmp_path}/cache").count() == 1500

    def held(batches):
        from velloom.llm import shared

        memo = getattr(shared._kept[1], "memo", {})
        size = sys.getsizeof(memo) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in memo.items())
        for batch in batches:
            yield pa.record_batch([pa.array([size] * batch.num_rows, pa.int64())], names=["size"])

    most = max(r.size for r in spark.range(0, 64, 1, 64).mapInArrow(held, "size long").collect())
    assert 1_000_000 < most < tokenizing.ROOM
