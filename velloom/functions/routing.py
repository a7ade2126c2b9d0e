"""Which model, prompt and path a text takes, as Column expressions; settings are parameters, never a worker's environment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clip, first_set, is_blank, looks_like_form, strip

#: The default corrector, tokenizers that go by another name than their model, models that want a prefix, and the prefix.
DEFAULT_MODEL = "ai-forever/sage-v1.1.0"
TOKENIZERS = {"ai-forever/sage-v1.1.0": "ai-forever/FRED-T5-1.7B"}
PREFIXED, PREFIX = ("ai-forever/sage-v1.1.0",), "<LM>"
#: Words of a pack, for sequence models and for chat models.
SHORT_PACK, LONG_PACK = 24, 220
#: What the phases of a job are called.
PHASES = {
    "queued": "В очереди", "pdf": "Чтение PDF", "segment": "Сегментация", "load": "Загрузка модели",
    "recognize": "Распознавание", "correct": "Коррекция текста", "done": "Готово", "error": "Ошибка",
}
DOT = " · "


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The key's value, null for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def model_id(*settings: Column) -> Column:
    """PRJ3: the first model that is set, else the default."""
    return first_set(*settings, F.lit(DEFAULT_MODEL))


def tokenizer_id(setting: Column, model: Column) -> Column:
    """PRJ3, JN7: the tokenizer that is set, else the one that goes with the model, else the model's own."""
    return F.coalesce(F.nullif(setting, F.lit("")), _lookup(TOKENIZERS, model), model)


def is_seq2seq(model: Column) -> Column:
    """FLT7."""
    name = F.lower(model)
    return F.contains(name, F.lit("sage")) | F.contains(name, F.lit("fredt5"))


def pack_words(model: Column, setting: Column) -> Column:
    """WIN8's limit: as set, else by the kind of model."""
    return F.coalesce(setting.cast("int"), F.when(is_seq2seq(model), SHORT_PACK).otherwise(LONG_PACK))


def with_prefix(model: Column, text: Column) -> Column:
    """MDL4: what a sequence model reads."""
    return F.when(model.isin(*PREFIXED), F.concat(F.lit(PREFIX), text)).otherwise(text)


def seq2seq_length(tokens: Column) -> Column:
    """MDL4: most tokens of an answer to ``tokens``: half as many again, truncated, from 32 to 512."""
    return F.least(F.lit(512), F.greatest(F.lit(32), (tokens * 1.5).cast("int")))


def causal_length(tokens: Column) -> Column:
    """MDL5: most new tokens for ``tokens`` of source: 1.3 times as many, truncated, and 16; from 24 to 384."""
    return F.least(F.lit(384), F.greatest(F.lit(24), (tokens * 1.3).cast("int") + 16))


def page_tokens(bands: Column) -> Column:
    """MDL3: token budget of a page model: 1536 for one of several bands, 2048 for a whole page."""
    return F.when(bands > 1, 1536).otherwise(2048)


def engine_of(name: Column) -> Column:
    """MDL6: the engine that serves a request; any other name means the default one."""
    return F.when(name.isin("chandra", "trocr"), name).otherwise("tesseract")


def goes_to_model(segment: Column) -> Column:
    """MDL8: whether a segment is corrected; blank ones and scraps of forms stay as they are."""
    return ~F.coalesce(is_blank(segment), F.lit(True)) & ~looks_like_form(segment)


def prompt_mode(setting: Column) -> Column:
    """SCL21: a struct of the prompt's kind and whether the language's own prompt goes with it."""
    mode = F.lower(strip(F.coalesce(setting, F.lit("ocr"))))
    return F.struct(F.when(mode == "ocr_layout", mode).otherwise("ocr").alias("kind"), (~mode.isin("ocr_layout", "generic", "stock", "en")).alias("own_prompt"))


def refine_prompt(draft: Column, before: str, after: str) -> Column:
    """SCL18: the prompt of a second look at a page: instructions, the clipped draft, instructions."""
    return strip(F.concat(F.lit(f"{before}\n\n"), clip(draft), F.lit(f"\n\n{after}")))


def phase_label(phase: Column) -> Column:
    """SCL20: a phase as it is shown; unknown heads stay, details follow; a dash for none."""
    parts = F.split(phase, DOT)
    head = F.get(parts, F.lit(0))
    label = F.coalesce(_lookup(PHASES, head), head)
    return F.when(F.coalesce(phase, F.lit("")) == "", "—").otherwise(F.concat_ws(DOT, label, F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1))))


def languages(names: Column) -> Column:
    """SRC8, ORD5: the languages of an installation in alphabetical order."""
    return F.array_sort(names)
