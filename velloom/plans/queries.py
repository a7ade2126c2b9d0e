"""The registered queries of the document operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import jobs, lines, series

#: A text as a correction model might return it: every second text loses its letters, others gain a tail.
_BROKEN = {"spark": "case when doc_id % 3 = 0 then regexp_replace(text, '[A-Za-z]', '.') when doc_id % 3 = 1 then text else '' end"}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` by ``key`` in the session's number of partitions, which isn't lowered for few bytes: what follows costs far more than its bytes show."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    return lines.join_pages(_t(spark, sf, "conversations"), "conv_id", "turn")


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.select((F.col("event_id") % 50).cast("long").alias("page"), F.floor(F.col("event_id") / 50).cast("long").alias("y"), "value")


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    state = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "view", "running")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("status"), "value")


def word_count(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


def html_to_text(spark, sf):
    t = _t(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))
    return t.select("page_id", "text", text.word_count(F.col("text")).alias("words"))


def page_concat(spark, sf):
    return _chats(spark, sf)


def run_cap_lines(spark, sf):
    kept = lines.cap_runs_in_place(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(kept).alias("n_kept"), F.array_join(kept, "\n").alias("text"))


def tex_strip(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.drop_tex(F.col("text")).alias("text"))


def sentence_units(spark, sf):
    d = lines.explode_lines(_t(spark, sf, "documents"), ["doc_id"])
    return d.select("doc_id", "line_no", F.posexplode(text.sentence_units(F.col("line"))).alias("unit_no", "unit"))


def packs_24(spark, sf):
    d = lines.explode_lines(_t(spark, sf, "documents"), ["doc_id"]).where(~text.is_blank(F.col("line")))
    return d.select("doc_id", "line_no", F.posexplode(text.pack(text.sentence_units(F.col("line")), 24, " ")).alias("pack_no", "pack"))


def chunk_words(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(text.chunks(F.col("text"), 24)).alias("chunk_no", "chunk"))


def paragraph_blocks(spark, sf):
    return lines.paragraphs(_chats(spark, sf), ["conv_id"])


def export_rows(spark, sf):
    return lines.sheet_rows(_chats(spark, sf), ["conv_id"])


def collapse_guard(spark, sf):
    d = _t(spark, sf, "documents").withColumn("candidate", F.expr(_BROKEN["spark"]))
    chosen = text.prefer_original(F.col("text"), F.col("candidate"), "[A-Za-z]")
    return d.select("doc_id", (chosen == F.col("candidate")).alias("took_candidate"))


def form_fragment(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.looks_like_form(F.col("html")).alias("form"))


def counter_rate(spark, sf):
    e = _t(spark, sf, "events")
    w = "sum(cast(value as decimal(18,2))) over (partition by user_id order by ts, event_id)"
    e = e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.expr(f"cast({w} as double)").alias("sent"))
    return jobs.rates(e, "user_id", "at", "sent", tie="event_id").select("event_id", "user_id", "rate")


def job_retention(spark, sf):
    return jobs.retained(_t(spark, sf, "events").select("event_id", "ts", "user_id"), "ts", "event_id")


def job_state(spark, sf):
    return jobs.fold(_changes(spark, sf), "job_id", "seq", ["status", "value"])


def log_filter(spark, sf):
    e = _t(spark, sf, "events").withColumn("m", F.concat(F.when(F.col("event_id") % 3 == 0, "/api/progress/").when(F.col("event_id") % 3 == 1, "/api/metrics").otherwise("/api/export/"), F.col("event_type")))
    return e.where(jobs.loud(F.col("m"))).select("event_id", "m")


def validate_upload(spark, sf):
    e = _t(spark, sf, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "text/plain").otherwise("image/png")
    engine = F.when(F.col("event_id") % 7 == 0, "other").otherwise("trocr")
    corrector = F.when(F.col("event_id") % 13 == 0, "magic").when(F.col("event_id") % 13 == 1, "spell").otherwise("none")
    return e.select("event_id", jobs.upload_status(kind, engine, corrector, (F.col("event_id") % 11) * 4_000_000).alias("status"))


def jaccard_lines(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.posexplode(text.neighbour_overlaps(F.col("text"))).alias("before", "jaccard"))
    return d.select("doc_id", (F.col("before") + 1).alias("line_no"), F.round("jaccard", 9).alias("jaccard"))


def box_smooth(spark, sf):
    return series.box_mean(_profile(spark, sf), ["page"], "y", "value", 15).select("page", "y", F.round("smooth", 6).alias("smooth"))


def local_minima(spark, sf):
    return series.local_minima(_profile(spark, sf), ["page"], "y", "value")


def valley_sessions(spark, sf):
    return series.sessions(series.local_minima(_profile(spark, sf), ["page"], "y", "value"), ["page"], "y", "value")


def human_bytes(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.human_bytes(F.pow(F.col("n_chars").cast("double"), 2)).alias("size"))


def match_case(spark, sf):
    d = _t(spark, sf, "documents")
    first = F.try_element_at(text.words(F.col("text")), F.lit(1))
    return d.select("doc_id", text.match_case(first, F.lit("word")).alias("word"))


def html_to_text_full(spark, sf):
    return _t(spark, sf, "pages").select("page_id", similarity.each(similarity.html_to_text)(F.col("html")).alias("text"))


def _alike_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    split = F.split("text", "\n")
    pairs = text.let(split, lambda x: F.transform(F.filter(x, lambda y, i: i > 0), lambda y, i: F.struct((i + 1).alias("line_no"), F.get(x, i).alias("before"), y.alias("line"))))
    d = df.where("text is not null").select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return d.select(*keys, "line_no", F.round(similarity.each(similarity.line_similarity, "double")(F.col("line"), F.col("before")), 9).alias("similarity"))


def line_similarity(spark, sf):
    return _alike_lines(_t(spark, sf, "documents"), ["doc_id"])


def turn_similarity(spark, sf):
    return _alike_lines(_chats(spark, sf), ["conv_id"])


def near_line_merge(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", similarity.each(similarity.merge_near_lines)(F.col("text")).alias("text"))


def near_turn_merge(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", similarity.each(similarity.merge_near_lines)(F.col("text")).alias("text"))


def phrase_loops(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", text.phrase_loops(F.col("text")).alias("text"))


def refine_guard(spark, sf):
    c = dealt(_t(spark, sf, "conversations"), "conv_id").groupBy("conv_id").agg(F.max_by("text", "turn").alias("refined"), F.min_by("text", "turn").alias("draft"))
    return c.select("conv_id", similarity.each(similarity.prefer_refined)(F.col("draft"), F.col("refined")).alias("text"))


def text_selection(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("which", F.when(F.col("turn") % 3 == 0, "text").otherwise("corrected"))
    corrected = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("= "), F.col("text"))).otherwise("")
    return c.select("conv_id", "turn", text.select_text(F.col("which"), F.col("text"), corrected).alias("text"))


def progress_clamp(spark, sf):
    e = _t(spark, sf, "events")
    return e.select("event_id", F.round(text.progress((F.col("event_id") % 5) / 5.0, F.col("value") / 250.0, F.lit(0.2)), 6).alias("progress"))


def word_confidence(spark, sf):
    found = F.transform(text.words(F.col("text")), lambda w: F.struct(w.alias("text"), (F.length(w) % 7 - 1).cast("double").alias("confidence")))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.round(jobs.mean_confidence(found), 6).alias("confidence"))


def page_confidence(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("part", F.floor(F.col("turn") / 2).cast("long"))
    return c.groupBy("conv_id", "part").agg(jobs.page_confidence(F.length("text").cast("double")).alias("confidence"))


def export_status(spark, sf):
    e = _t(spark, sf, "events")
    fmt = F.when(F.col("event_id") % 6 == 0, "rtf").otherwise("docx")
    status = F.when(F.col("event_type") == "view", "running").otherwise("done")
    name = jobs.export_name(F.md5(F.col("event_id").cast("string").cast("binary")), fmt)
    return e.select("event_id", jobs.export_status(fmt, F.col("user_id") % 4 != 0, status).alias("status"), name.alias("file_name"))


def cap_runs(spark, sf):
    return lines.cap_runs(_t(spark, sf, "documents"), ["doc_id"])


def step_timings(spark, sf):
    e = _t(spark, sf, "events")
    ended = F.col("value") + (F.unix_micros(F.col("ts").cast("timestamp")) % 1000).cast("double")
    return e.select("event_id", jobs.timings(F.lit(0.0), F.col("value"), ended).alias("t")).select("event_id", "t.*")


def profile_middles(spark, sf):
    m = series.middles(_profile(spark, sf), ["page"], "value")
    return m.select("page", F.round("median", 6).alias("median"), "upper_median", F.round("paper", 6).alias("paper"))


def regroup_lines(spark, sf):
    e = _t(spark, sf, "events").select("user_id", (F.col("event_id") % 7).alias("line_no"), "event_id", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")).alias("word"))
    return lines.regroup(e, "user_id", "line_no", "event_id", "word")


def unknown_words(spark, sf):
    said = _t(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.words(F.col("text"))).alias("word"))
    known = _t(spark, sf, "benchmark").select(F.explode(text.words(F.col("text"))).alias("word"))
    return lines.unknown_words(said, known).groupBy("conv_id").agg(F.count("*").alias("n_unknown"), F.countDistinct("word").alias("n_distinct"))


def prompt_clip(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.clip(F.col("text")).alias("draft"))


_ANSWER = "case doc_id % 3 when 0 then concat('```text', chr(10), 'ТЕКСТ: ', text, chr(10), '```') when 1 then concat('Исправленный текст:', chr(10), text) else text end"


def answer_text(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", text.strip_completion(F.expr(_ANSWER)).alias("text"))


def settings(spark, sf):
    e = _t(spark, sf, "events")
    on = F.when(F.col("event_id") % 4 == 0, " Off ").when(F.col("event_id") % 4 == 1, "1").when(F.col("event_id") % 4 == 2, "no")
    model = text.first_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" "), F.when(F.col("event_id") % 5 != 0, F.col("props")), F.lit("default"))
    return e.select("event_id", text.truthy(on).alias("is_on"), model.alias("model"))


def repeated_tail(spark, sf):
    d = _t(spark, sf, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    return d.select("doc_id", text.repeats_head(head, tail, "[A-Za-z]").alias("repeats"))


_WS, _BLACK = r"[\s\x{0B}\x{85}\p{Z}]", r"[^\s\x{0B}\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _n(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_BLACK}+'))"


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_no from documents where text is not null)"
_CHAT = "(select conv_id, string_agg(text, chr(10) || chr(10) order by turn) text, count(*) pages from conversations group by conv_id)"
_CHAT_LINES = f"(select conv_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) line_no from {_CHAT})"
UNITS = f"list_filter(list_transform(string_split(regexp_replace(line, '([.!?…]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda u: {_strip('u')}), lambda u: u <> '')"


def packs_sql(units: str, limit: int, joiner: str) -> str:
    """A list of packs of a list of units: a fold over structs of closed packs, the open one and its words."""
    each = f"list_transform({units}, lambda u: {{'d': []::varchar[], 'o': u, 'w': {_n('u')}}})"
    full = f"a.w + b.w > {limit}"
    step = f"{{'d': case when {full} then list_append(a.d, a.o) else a.d end, 'o': case when {full} then b.o else a.o || '{joiner}' || b.o end, 'w': case when {full} then b.w else a.w + b.w end}}"
    folded = f"list_reduce({each}, lambda a, b: {step})"
    return f"list_append(({folded}).d, ({folded}).o)"


_PROFILE = "(select event_id % 50 page, event_id // 50 y, value from events)"
_MINIMA = f"(select page, y, value from (select *, lag(value) over w a, lead(value) over w b, max(value) over (partition by page) m from {_PROFILE} window w as (partition by page order by y)) where value <= a and value <= b and value <= 0.32 * m)"


def _words_sql(c: str) -> str:
    return f"len(regexp_extract_all(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'))"


def _html_sql(c: str) -> str:
    s = c
    for pattern, new in ((r"(?i)<img[^>]*>", "''"), (r"(?i)<br\s*/?>", "chr(10)"), (f"(?i)</({text.BLOCK_ENDS})>", "chr(10) || chr(10)"), ("<[^>]+>", "''"), (r"(?m)<[a-zA-Z][^>\n]*$", "''")):
        s = f"regexp_replace({s}, '{pattern}', {new}, 'g')"
    for name, char in text.ENTITIES:
        s = f"replace({s}, '{name.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    s = f"regexp_replace(regexp_replace({s}, '[\\t\\r\\f\\x{{0B}}\\x{{85}}\\p{{Z}}]*\\n[\\t\\r\\f\\x{{0B}}\\x{{85}}\\p{{Z}}]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"case when contains({c}, '<') then {_strip(s)} else {_strip(c)} end"


def oracle_blocks() -> str:
    return f"select conv_id, row_number() over (partition by conv_id order by g) - 1 block_no, block, n_lines from (select conv_id, g, string_agg(line, chr(10) order by line_no) block, count(*) n_lines from (select *, sum(({_n('line')} = 0)::int) over (partition by conv_id order by line_no) g from {_CHAT_LINES}) where {_n('line')} > 0 group by conv_id, g)"


def oracle_job_state() -> str:
    return "select user_id job_id, arg_max(s, event_id) filter (s is not null) status, arg_max(value, event_id) filter (value is not null) \"value\", count(*) changes from (select *, case event_type when 'error' then 'error' when 'purchase' then 'done' when 'view' then 'running' end s from events) group by user_id"


def _oracle() -> dict[str, str]:
    tex = "text"
    for pattern, new in ((r"(?s)\\begin\{[a-zA-Z*]+\}.*?\\end\{[a-zA-Z*]+\}", "''"), (r"\$\$.*?\$\$|\$[^$\n]+\$", "''"), (rf"\\(?:{text.TEX_COMMANDS})(?:\s*\{{[^{{}}]*\}})*", "''"), (r"\\[a-zA-Z]+\*?", "''"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")):
        tex = f"regexp_replace({tex}, '{pattern}', {new}, 'g')"
    answer = f"(select doc_id, {_strip(f"regexp_replace({_strip(f'({_ANSWER})')}, '(?m)^```(?:[\\p{{L}}\\p{{N}}_]+)?{_WS}*|{_WS}*```$', '', 'g')")} s from documents where text is not null)"
    for label in text.LABELS:
        answer = f"(select doc_id, case when starts_with(lower(s), lower('{label}')) then regexp_replace(substr(s, {len(label) + 1}), '^[ \\n:]+', '') else s end s from {answer})"
    jac = lambda c: f"list_distinct(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '{_BLACK}+'))"
    cand = "case when doc_id % 3 = 0 then regexp_replace(text, '[A-Za-z]', '.', 'g') when doc_id % 3 = 1 then text else '' end"
    n = lambda c: f"len(regexp_extract_all({c}, '[A-Za-z]'))"
    x = "power(n_chars, 2)"
    return {
        "word_count": f"select doc_id, {_words_sql('text')} words from documents",
        "html_to_text": f"select page_id, text, {_words_sql('text')} words from (select page_id, {_html_sql('html')} text from pages)",
        "page_concat": f"select * from {_CHAT}",
        "run_cap_lines": f"select doc_id, count(*) n_kept, string_agg(line, chr(10) order by line_no) text from (select *, lag(line) over w a, lag(line, 2) over w b from {_LINES} window w as (partition by doc_id order by line_no)) where not coalesce(line = a and line = b, false) group by doc_id",
        "tex_strip": f"select doc_id, {_strip(tex)} text from documents",
        "sentence_units": f"select doc_id, line_no, unnest(range(len(u))) unit_no, unnest(u) unit from (select doc_id, line_no, case when {_n('line')} = 0 then [line] else {UNITS} end u from {_LINES})",
        "packs_24": f"select doc_id, line_no, unnest(range(len(p))) pack_no, unnest(p) pack from (select doc_id, line_no, {packs_sql(UNITS, 24, ' ')} p from {_LINES} where {_n('line')} > 0)",
        "chunk_words": f"select doc_id, k chunk_no, array_to_string(w[24 * k + 1 : 24 * k + 24], ' ') chunk from (select doc_id, w, unnest(range(greatest(1, (len(w) + 23) // 24))) k from (select doc_id, regexp_extract_all(text, '{_BLACK}+') w from documents where text is not null))",
        "paragraph_blocks": oracle_blocks(),
        "export_rows": f"select conv_id, row_number() over (partition by conv_id order by line_no) row_no, line from {_CHAT_LINES} where {_n('line')} > 0",
        "collapse_guard": f"select doc_id, case when {_n('c')} = 0 or ({n('text')} >= 4 and {n('c')} < greatest(2, trunc({n('text')} * 0.5))) or ({n('text')} >= 4 and {n('c')} >= 3 and {n('c')} >= {n('c')}) or length({_strip('c')}) > greatest(80, trunc(length(text) * 2.8)) then text else c end = c took_candidate from (select doc_id, text, {cand} c from documents)",
        "form_fragment": r"select page_id, coalesce(contains(html, 'data-bbox') or contains(lower(html), '<div') or contains(html, '___') or regexp_matches(html, '«\s*\d|\d\s*»'), false) form from pages",
        "counter_rate": "select event_id, user_id, coalesce(round(greatest(0.0, (sent - lag(sent) over w) / greatest(1e-3, \"at\" - lag(\"at\") over w)) * (8 / 1e6), 2), 0.0) rate from (select event_id, user_id, epoch_us(ts) / 1e6 \"at\", sum(value::decimal(18,2)) over (partition by user_id order by ts, event_id)::double sent from events) window w as (partition by user_id order by \"at\", event_id)",
        "job_retention": "select event_id, ts, user_id from events order by ts desc, event_id desc limit 50",
        "job_state": oracle_job_state(),
        "log_filter": "select event_id, '/api/export/' || event_type m from events where event_id % 3 = 2",
        "validate_upload": f"select event_id, case when event_id % 5 = 0 then 415 when event_id % 7 = 0 then 400 when event_id % 13 = 0 then 400 when event_id % 11 = 0 then 400 when (event_id % 11) * 4000000 > {jobs.MOST_BYTES} then 413 else 200 end status from events",
        "jaccard_lines": f"select doc_id, line_no, round(case when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end, 9) jaccard from (select doc_id, line_no, {jac('a')} x, {jac('line')} y from (select *, lag(line) over (partition by doc_id order by line_no) a from {_LINES}) where a is not null)",
        "box_smooth": f"select page, y, round(sum(value) over (partition by page order by y rows between 7 preceding and 7 following) / 15, 6) smooth from {_PROFILE}",
        "local_minima": f"select * from {_MINIMA}",
        "valley_sessions": f"select page, g \"group\", first(y order by value, y) y, min(value) \"value\", count(*) members from (select page, y, value, sum(new) over (partition by page order by y) g from (select *, coalesce((y - lag(y) over (partition by page order by y) > 12)::int, 1) new from {_MINIMA})) group by page, g",
        "human_bytes": f"select doc_id, case when {x} < 1024 then format('{{:.1f}} B', {x}) when {x} / 1024 < 1024 then format('{{:.1f}} KB', {x} / 1024) when {x} / 1048576 < 1024 then format('{{:.1f}} MB', {x} / 1048576) else format('{{:.1f}} GB', {x} / 1073741824) end size from documents",
        "text_selection": "select conv_id, turn, case when turn % 3 <> 0 and conv_id % 2 = 0 and text is not null then '= ' || text else coalesce(text, '') end text from conversations",
        "progress_clamp": "select event_id, round(least(0.999::double, greatest(0::double, (event_id % 5) / 5 + value / 250 * 0.2::double)), 6) progress from events",
        "word_confidence": f"select conv_id, turn, round(coalesce(list_avg(list_filter(list_transform(regexp_extract_all(text, '{_BLACK}+'), lambda w: (length(w) % 7 - 1)::double), lambda c: c >= 0)), 0), 6) confidence from conversations",
        "page_confidence": "select conv_id, turn // 2 part, case when count(*) = 1 then max(length(text))::double end confidence from conversations group by all",
        "export_status": "select event_id, case when event_id % 6 = 0 then 400 when user_id % 4 = 0 then 404 when event_type = 'view' then 409 else 200 end status, 'ocr-' || substr(md5(event_id::varchar), 1, 8) || case when event_id % 6 = 0 then '.rtf' else '.docx' end file_name from events",
        "cap_runs": f"select doc_id, line_no, line from (select *, lag(line) over w a, lag(line, 2) over w b from {_LINES} window w as (partition by doc_id order by line_no)) where not coalesce(line = a and line = b, false)",
        "step_timings": "select event_id, trunc(value * 1000)::bigint recognize_ms, trunc((value + r - value) * 1000)::bigint correct_ms, trunc((value + r) * 1000)::bigint total_ms from (select event_id, value, (epoch_us(ts) % 1000)::double r from events)",
        "profile_middles": f"select page, round(quantile_cont(value, 0.5), 6) median, max(value) filter (k = n // 2 + 1) upper_median, round(quantile_cont(value, 0.9), 6) paper from (select *, row_number() over (partition by page order by value) k, count(*) over (partition by page) n from {_PROFILE}) group by page",
        "regroup_lines": "select user_id, string_agg(one, chr(10) order by line_no) text, count(*) n_lines from (select user_id, event_id % 7 line_no, string_agg(event_type, ' ' order by event_id) one from events where event_type <> 'view' group by all) group by user_id",
        "unknown_words": f"select conv_id, count(*) n_unknown, count(distinct word) n_distinct from (select conv_id, unnest(regexp_extract_all(text, '{_BLACK}+')) word from conversations) where lower(word) not in (select lower(unnest(regexp_extract_all(text, '{_BLACK}+'))) from benchmark) group by conv_id",
        "prompt_clip": f"select doc_id, substr({_strip('coalesce(text, chr(32))')}, 1, 1800) draft from documents",
        "answer_text": f"select doc_id, {_strip('s')} text from {answer}",
        "settings": "select event_id, event_id % 4 = 1 is_on, case when event_id % 3 = 0 then event_type when event_id % 5 <> 0 then props else 'default' end model from events",
        "repeated_tail": "select doc_id, coalesce(len(b) >= 4 and len(a) > 0 and len(list_intersect(a, b)) >= 3 and len(list_intersect(a, b)) / greatest(len(b), 1) >= 0.22, false) repeats from (select doc_id, list_distinct(regexp_extract_all(lower(substr(text, 1, (length(text) // 2)::int)), '[A-Za-z]{5,}')) a, list_distinct(regexp_extract_all(lower(substr(text, (length(text) // 2)::int + 1)), '[A-Za-z]{5,}')) b from documents)",
        "match_case": "select doc_id, case when w = upper(w) and w <> lower(w) then 'WORD' when w[1] = upper(w[1]) and w[1] <> lower(w[1]) then 'Word' else 'word' end word from (select doc_id, regexp_extract(text, '[^\\s\\x{0B}\\x{85}\\p{Z}]+') w from documents)",
    }


_QUERIES = (text_selection, progress_clamp, word_confidence, page_confidence, export_status, cap_runs, step_timings, profile_middles, regroup_lines, unknown_words, prompt_clip, answer_text, settings, repeated_tail, word_count, html_to_text, page_concat, run_cap_lines, tex_strip, sentence_units, packs_24, chunk_words, paragraph_blocks, export_rows, collapse_guard, form_fragment, counter_rate, job_retention, job_state, log_filter, validate_upload, jaccard_lines, box_smooth, local_minima, valley_sessions, human_bytes, match_case, html_to_text_full, line_similarity, turn_similarity, near_line_merge, near_turn_merge, phrase_loops, refine_guard)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import service

    return {f.__name__: f for f in (*_QUERIES, *service.QUERIES)}


def oracle_sql() -> dict[str, str]:
    from . import service

    return _oracle() | service.oracle()
