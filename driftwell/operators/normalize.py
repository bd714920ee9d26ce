"""Schema resolution, normalisation and templated text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell import fixed_values as fv
from driftwell.functions.text import SPACE, first_label, is_blank, or_default, trim_all, word_count
from driftwell.operators.rounds import with_position


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """Name of the first candidate among the columns of ``df``."""
    return next((c for c in candidates if c in df.columns), None)


def text_column(df: DataFrame, instruction_first: bool = False) -> Column:
    """The text of a row. ``instruction_first`` prefers a labelled instruction/input pair."""
    pair = {"instruction", "input"} <= set(df.columns)
    if pair and instruction_first:
        return F.concat(
            F.lit("Instruction: "), F.col("instruction").cast("string"),
            F.lit("\nInput: "), F.col("input").cast("string"),
        )
    name = first_existing(df, fv.TEXT_COLUMNS)
    if name:
        return F.col(name).cast("string")
    if pair:
        return trim_all(F.concat_ws("\n", F.col("instruction").cast("string"), F.col("input").cast("string")))
    return F.concat_ws(" | ", *[F.col(c).cast("string") for c in df.columns])


def label_column(df: DataFrame, candidates: Sequence[str] = fv.LABEL_COLUMNS) -> Column:
    name = first_existing(df, candidates)
    return F.col(name).cast("string") if name else F.lit("unknown")


def prompt_column(df: DataFrame) -> Column:
    return F.col("prompt").cast("string") if "prompt" in df.columns else F.lit("")


def parse_time(df: DataFrame, name: str) -> Column:
    """UTC wall time, NULL where the value cannot be read. The session must run in UTC."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.col(name)
    if isinstance(dt, (T.TimestampType, T.DateType)):
        return F.col(name).cast("timestamp_ntz")
    return F.try_to_timestamp(F.col(name).cast("string")).cast("timestamp_ntz")


def hourly_times(df: DataFrame, key: str, now: str, anchor: str = "end", window_days: int = 30, every_seconds: int = 3600) -> DataFrame:
    """Give row i of n (in ``key`` order) an hourly time: the last row at ``now`` (``end``), or
    the first ``window_days`` before it and onwards (``start``). Adds ``ts``, ``row_idx``,
    ``total_rows``.

    No two rows share a time. Hours leave the years 1 to 9999, which some programs can't show, after 17.7 million rows before
    2024 and 69.9 million behind it; take a shorter step for such tables. Spark's own times end after 2.5 billion
    hours; beyond, the job fails.
    """
    at = with_position(df, [key])
    now_c = F.lit(now).cast("timestamp_ntz")
    step = F.expr(f"interval '{int(every_seconds)}' second")
    if anchor == "end":
        ts = now_c - step * (F.col("total_rows") - 1 - F.col("row_idx"))
    elif anchor == "start":
        ts = now_c - F.expr(f"interval '{int(window_days)}' day") + step * F.col("row_idx")
    else:
        raise ValueError(f"anchor must be 'end' or 'start', not {anchor!r}")
    return at.withColumn("ts", ts)


def normalize(
    df: DataFrame, key: str, now: str | None = None, anchor: str = "end", instruction_first: bool = False
) -> DataFrame:
    """``sample_id, prompt, text, label, ts`` from a table of any of the known layouts.

    Rows whose time cannot be read are dropped; without a time column hourly times are made up
    from the ``key`` order, ending at ``now``.
    """
    cols = [F.col(key).alias("sample_id"), *_content(df, instruction_first)]
    if first_existing(df, fv.TIME_COLUMNS):
        return _with_read_times(df, cols)
    return _made_up_times(df.select(*cols), now, anchor).select("sample_id", "prompt", "text", "label", "ts")


def sample_content(df: DataFrame, key: str, instruction_first: bool = False) -> DataFrame:
    """``sample_id, prompt, text, label`` as :func:`normalize` has them, of every row, so that the texts need not move for the times."""
    return df.select(F.col(key).alias("sample_id"), *_content(df, instruction_first))


def sample_times(df: DataFrame, key: str, now: str | None = None, anchor: str = "end") -> DataFrame:
    """``sample_id, ts`` of the rows that :func:`normalize` keeps, from the keys alone."""
    sample = F.col(key).alias("sample_id")
    if first_existing(df, fv.TIME_COLUMNS):
        return _with_read_times(df, [sample])
    return _made_up_times(df.select(sample), now, anchor).select("sample_id", "ts")


def _content(df: DataFrame, instruction_first: bool) -> list[Column]:
    return [prompt_column(df).alias("prompt"), text_column(df, instruction_first).alias("text"), label_column(df).alias("label")]


def _with_read_times(df: DataFrame, cols: Sequence[Column]) -> DataFrame:
    return df.select(*cols, parse_time(df, first_existing(df, fv.TIME_COLUMNS)).alias("ts")).filter(F.col("ts").isNotNull())


def _made_up_times(df: DataFrame, now: str | None, anchor: str) -> DataFrame:
    if now is None:
        raise ValueError("a table without a time column needs 'now'")
    return hourly_times(df, "sample_id", now, anchor)


def sentiment_label(text: Column, patterns: Sequence[tuple[str, str]] = fv.BRACKET_LABELS, default: str = "neutral") -> Column:
    return first_label(text, patterns, default)


def is_underlength(text: Column, min_words: int = fv.MIN_WORDS) -> Column:
    return is_blank(text) | (word_count(text) < F.lit(min_words))


def answer_after_marker(raw: Column, marker: str = "[/INST]") -> Column:
    """What follows the last marker, trimmed; the whole text if there is none."""
    quoted = marker.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]")
    return trim_all(F.regexp_replace(raw, f"(?s)^.*{quoted}{SPACE}*", ""))


def fill(template: str, **fields: Column) -> Column:
    """Column from a ``{name}`` template; NULL if a field is NULL."""
    parts: list[Column] = []
    rest = template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(fields[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def prompt_seed(prompt: Column) -> Column:
    """First line after the last ``Seed:`` of a prompt."""
    after = trim_all(F.element_at(F.split(prompt, "Seed:"), -1))
    return F.when(F.contains(prompt, F.lit("Seed:")), F.element_at(F.split(after, "\r\n|\n|\r"), 1)).otherwise(
        F.lit(fv.DEFAULT_SEED)
    )


def fallback_note(seed: Column, label: Column | None = None) -> Column:
    lab = F.lit("neutral") if label is None else F.when(label.isin(fv.SENTIMENTS), label).otherwise(F.lit("neutral"))
    return fill(fv.FALLBACK_NOTE, seed=seed, label=lab)


def best_attempts(
    df: DataFrame, keys: Sequence[str], attempt: str, text: str, prompt: str, min_words: int = fv.MIN_WORDS
) -> DataFrame:
    """One row per ``keys``: the first long enough attempt, else the fallback note for the
    prompt (for the default seed when every attempt is blank)."""
    raw = trim_all(F.col(text))
    long_enough = ~is_underlength(F.col(text), min_words)
    return (
        df.groupBy(*keys)
        .agg(
            F.min_by(F.when(long_enough, raw), F.when(long_enough, F.col(attempt))).alias("_best"),
            F.max(~is_blank(F.col(text))).alias("_any"),
            F.min(prompt).alias("_prompt"),
        )
        .select(
            *keys,
            F.coalesce(
                F.col("_best"),
                fallback_note(F.when(F.col("_any"), prompt_seed(F.col("_prompt"))).otherwise(F.lit(fv.DEFAULT_SEED))),
            ).alias("text"),
            F.col("_best").isNull().alias("is_fallback"),
        )
    )


def public_columns(df: DataFrame) -> DataFrame:
    """Without the columns that only a client may know."""
    return df.drop(*fv.LOCAL_ONLY_COLUMNS)


def clean_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Trimmed labels; rows without one are dropped."""
    return df.withColumn(label, trim_all(F.col(label).cast("string"))).filter(F.col(label) != "")


def guidance_text(round_id: Column, prior: Column, label: Column, topic: Column, template: str) -> Column:
    return fill(
        template,
        round_id=round_id,
        topic=F.coalesce(trim_all(topic), F.lit(fv.DEFAULT_TOPIC)),
        prior=trim_all(prior),
        label=or_default(label, "neutral"),
    )


def lookup_snippet(code: Column, answer: Column, meaning: Column, sector: Column) -> Column:
    """Text that teaches a private code; lines without content are left out."""

    def line(head: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))

    return F.concat_ws(
        "\n",
        F.lit(fv.LOOKUP_MARKER),
        F.concat(F.lit("Code: "), code),
        F.concat(F.lit("Answer: "), answer),
        line("Meaning: ", meaning),
        line("Affected sector: ", sector),
    )


def lookup_question(code: Column) -> Column:
    return F.concat(F.lit(f"{fv.LOOKUP_MARKER}\nCode: "), trim_all(code), F.lit("\nAnswer:"))


def copies(times: int = 1, concept: str = "drift_concept") -> Column:
    """How often a row counts: ``times`` if it carries a concept, else once."""
    return F.when(is_blank(F.col(concept)), F.lit(1)).otherwise(F.lit(max(1, int(times))))


def oversample(df: DataFrame, times: int = 1, concept: str = "drift_concept") -> DataFrame:
    """Repeat the rows that carry a concept; ``copy_no`` starts at 1."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies(times, concept))))
