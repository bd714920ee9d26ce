"""Benchmark decontamination by templates.

Texts become tokens of letters or of digits (with a point or comma between digits); each character
of a script written without spaces (Chinese, Japanese, Thai and the like) is a token of its own, with
the marks behind it. Unicode spaces, punctuation and symbols are no tokens. A number, a
name (a capitalised word with a small second letter inside a sentence) and a unit become a typed
placeholder; other words are lower-cased. Windows of ``WIDTH`` such tokens are hashed in two
ways: as templates if they have at least ``LITERALS`` words, and all of them with the values in
their slots, so that verbatim copies are found whatever they consist of. A capitalised word that
opens a text or a sentence may be a name or not, so templates are hashed with both readings, on
both sides. A few words that open sentences (``OPENERS``) are never names. Benchmark items of fewer
tokens (``SHORTEST`` at least) are one window of their own length.

The hashes of the benchmark fill a bit field of fixed size (2**24 bits), which is sent to all
tasks; windows of documents that miss it are dropped where they are made. The others are joined
with the windows of the benchmark by hash, over salted keys, as one passage may be in a third of
the documents. Windows of one document and item at one shift form an alignment, and those of them
that share tokens a run. A run counts if its slots are consistent: each value of the item stands
for one value in the document (two values may have become the same). So a question with other
numbers and names is found, and a text that merely has numbers and names in the same places, but
mixes them up, is not. Of an inconsistent run the windows with the item's own values count.

Defined cases: null and empty texts, items that are null or too short, and null ids match
nothing; documents or items that share an id are reported together; repeated rows change nothing;
an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.common import byte_view, in_steps, stored
from driftwell.llm.memory import spread
from driftwell.llm.words import FIRST, SECOND, SHORT, mix, rehash_long

WIDTH, LITERALS, SHORTEST = 8, 5, 4
STEP = 1 << 19  # bytes of text at a time
FILTER_BITS = 24
SALTS = 16

# Units of measure and money, as written.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degrees celsius fahrenheit mph kph watt watts volt volts joule joules"
).split()

# Words that are no names wherever they stand, in the languages of the corpus.
OPENERS = (
    "what which who whom whose when where why how if the a an this that these those there here it is are was were do does did can could would should you he she we they "
    "at for from to of and or but not no as by with then so all each every some let find given suppose "
    "wer wie wo wann warum welche welcher welches der die das den dem des ein eine einen einem einer ist sind wenn und oder aber im auf für von zu mit er sie wir ihr "
    "qui que quoi quel quelle quels quelles quand où pourquoi comment le la les un une des est sont si et ou mais dans sur pour de il elle nous vous ils elles "
    "qué quién cuál cuáles cuándo dónde cómo cuánto el los las una unos unas es son y pero en con para por se lo"
).split()

LETTER, DIGIT, ALONE, MARK, STOP = 1, 2, 3, 4, 5  # a character that is a token, a mark behind one; the end of a sentence
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[ord("a") : ord("z") + 1] = CLASS[ord("A") : ord("Z") + 1] = CLASS[128:] = LETTER
CLASS[ord("0") : ord("9") + 1] = DIGIT
BREAKS = np.zeros(256, dtype=bool)
BREAKS[list(b".!?:;|\n\r\"")] = True
# Blocks of scripts written without spaces, and what ends or opens a sentence there or quotes.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
SPACED = ((0x3130, 0x318F),)  # Korean letters
STOPS = "\x85\u2028\u2029\u2026\u3002\uff01\uff1f\uff1b\uff1a\uff0e\uff61\u00a1\u00bf\u00ab\u00bb\u201c\u201d\u201e\u061f\u06d4\u0964"
NUMBER, NAME, UNIT = 1, 2, 3  # kinds of slots; 0 is a word
PLACEHOLDER = mix(np.array([0, 11, 12, 13], dtype=np.uint64))
VERBATIM = mix(np.array([14], dtype=np.uint64))[0]  # sets hashes of values apart from those of templates


@lru_cache(maxsize=1)
def kinds_of_characters() -> np.ndarray:
    """LETTER, DIGIT, ALONE, MARK, STOP or 0 for each code point."""
    unspaced = np.zeros(0x110000, dtype=bool)
    for a, b in UNSPACED:
        unspaced[a : b + 1] = True
    for a, b in SPACED:
        unspaced[a : b + 1] = False
    groups = [unicodedata.category(chr(c)) for c in range(0x110000)]
    out = np.array([0 if g[0] in "ZPS" or g == "Cc" or g == "Cf" else DIGIT if g == "Nd" else LETTER for g in groups], dtype=np.uint8)
    out[[0xAD, 0x200C, 0x200D]] = LETTER  # inside words
    out[unspaced & (out == LETTER)] = ALONE
    out[np.array([g[0] == "M" for g in groups]) & unspaced] = MARK
    out[[ord(c) for c in STOPS]] = STOP
    return out


def classify(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each byte's character; where a character begins that is a token; where a sentence ends."""
    kind, alone, stops = CLASS[data], np.zeros(len(data), dtype=bool), BREAKS[data]
    lead = np.flatnonzero(data >= 0xC2)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    whole = lead + size <= len(data)
    lead, size = lead[whole], size[whole]
    code = data[lead].astype(np.int64) & (0xFF >> size + 1)
    for k in (1, 2, 3):
        code = np.where(k < size, code << 6 | data[np.minimum(lead + k, len(data) - 1)] & 0x3F, code)
    found = kinds_of_characters()[np.minimum(code, 0x10FFFF)] if len(lead) else code
    alone[lead[found == ALONE]] = True
    stops[lead[found == STOP]] = True
    found = np.where(found == MARK, ALONE, np.where(found == STOP, 0, found))
    for k in range(4):
        kind[lead[k < size] + k] = found[k < size]
    return kind, alone, stops


def lower(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z, and the Latin letters of two bytes that begin with C3), and which bytes were capitals."""
    small = data.copy()
    capital = (data >= 65) & (data <= 90)
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        capital[:-1] |= accented
        small[1:][accented] |= 0x20
    small[(data >= 65) & (data <= 90)] |= 0x20
    return small, capital


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of tokens of each text; kind, template hash and value hash of each token."""
    return read_tokens(data, offsets)[:4]


def read_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Those of :func:`tokens`, and which words may be names as well."""
    kind, alone, stops = classify(data)
    if len(data) > 2:
        inner = ((data[1:-1] == 46) | (data[1:-1] == 44)) & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT)
        kind[1:-1][inner] = DIGIT
    begins = kind > 0
    begins[1:] &= (kind[1:] != kind[:-1]) | alone[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = kind[edge] > 0
    starts = np.flatnonzero(begins)
    per_text = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        none = np.zeros(0, dtype=np.uint64)
        return per_text, none.astype(np.int64), none, none, none.astype(bool)
    small, capital = lower(data)
    mark = np.zeros(len(data), dtype=np.int64)
    mark[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(mark)
    used = kind > 0
    place[~used] = 0
    value = word_values(small, place, starts, used)
    what = np.zeros(len(starts), dtype=np.int64)
    what[kind[starts] == DIGIT] = NUMBER
    broken = np.concatenate([[0], np.cumsum(stops & ~used)])[starts]
    opens = np.diff(broken, prepend=-1) > 0
    at = np.cumsum(per_text) - per_text
    opens[at[per_text > 0]] = True
    after = starts + np.where(data[starts] == 0xC3, 2, 1)
    tail = np.minimum(after, len(data) - 1)
    named = capital[starts] & (after < len(data)) & (kind[tail] == LETTER) & ~begins[tail] & ~capital[tail] & ~np.isin(value, NO_NAMES)
    what[named & ~opens] = NAME
    what[np.isin(value, UNIT_VALUES)] = UNIT
    return per_text, what, np.where(what > 0, PLACEHOLDER[what], value), value, named & (what == 0)


def word_values(small: np.ndarray, place: np.ndarray, starts: np.ndarray, used: np.ndarray) -> np.ndarray:
    powers = FIRST.powers(FIRST.base, SHORT)
    h = mix(np.add.reduceat(np.where(used, SECOND.of_byte[small] * powers[np.minimum(place, SHORT - 1)], np.uint64(0)), starts))
    return rehash_long(h, small, starts, np.maximum.reduceat(place, starts) + 1, SECOND.seed)


def _values(words: Sequence[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    size = np.array([len(w) for w in raw])
    starts = np.cumsum(size) - size
    return word_values(data, np.arange(len(data)) - np.repeat(starts, size), starts, np.ones(len(data), dtype=bool))


UNIT_VALUES, NO_NAMES = _values(UNITS), _values(OPENERS)


def windows(per_text: np.ndarray, what: np.ndarray, template: np.ndarray, value: np.ndarray, maybe: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first token (among all) and hash of each window as a template, in every reading with
    enough words, and of each window with its values; which ones are the latter; and the places of
    words read as names, as bits."""
    n = np.maximum(per_text - width + 1, 0)
    first = spread(np.cumsum(per_text) - per_text, n)
    text = np.repeat(np.arange(len(per_text)), n)
    count = np.concatenate([[0], np.cumsum(what == 0)])
    words, least = count[first + width] - count[first], min(LITERALS, width - 1)
    factors = SECOND.powers(SECOND.step, width)
    row = np.flatnonzero(words >= least)
    h, words, names = np.zeros(len(row), dtype=np.uint64), words[row], np.zeros(len(row), dtype=np.int64)
    for j, factor in enumerate(factors):
        h += template[first[row] + j] * factor
    doubt = np.concatenate([[0], np.cumsum(maybe)])
    some = np.flatnonzero(doubt[first[row] + width] > doubt[first[row]])
    several = row[some], h[some], words[some], names[some]
    for j, factor in enumerate(factors):
        at, sums, left, bits = several
        more = np.flatnonzero(maybe[first[at] + j] & (left > least))
        other = sums[more] + (PLACEHOLDER[NAME] - value[first[at[more]] + j]) * factor
        several = tuple(np.concatenate(z) for z in zip(several, (at[more], other, left[more] - 1, bits[more] | 1 << j)))
    row, h, _, names = (np.concatenate([x, y[len(some) :]]) for x, y in zip((row, h, words, names), several))
    verbatim = np.arange(len(row) + len(first)) >= len(row)
    row, names = np.concatenate([row, np.arange(len(first))]), np.concatenate([names, np.zeros(len(first), dtype=np.int64)])
    h = np.concatenate([mix(h), SECOND.windows(value, first, width) ^ VERBATIM]) ^ np.uint64(width)
    return text[row], first[row], h, verbatim, names


def _rows(batch: pa.RecordBatch, widths: Sequence[int], whole: bool, bits: np.ndarray | None = None) -> pa.RecordBatch:
    """``id, width, h, pos, verbatim, other, vals``: the windows of a batch; ``other`` if a word is
    read as a name; ``vals`` has the value of each slot and 0 for words. ``whole``: items; those shorter than the window are one window."""
    data, offsets = byte_view(batch.column("__text"))
    per_text, what, template, value, maybe = read_tokens(data, offsets)
    begin = np.cumsum(per_text) - per_text
    parts = []
    for width in widths:
        text, first, h, verbatim, names = windows(per_text, what, template, value, maybe, width)
        if whole and width < WIDTH:
            real = per_text[text] == width
            text, first, h, verbatim, names = text[real], first[real], h[real], verbatim[real], names[real]
        if bits is not None:
            cell = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            hit = (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) > 0
            text, first, h, verbatim, names = text[hit], first[hit], h[hit], verbatim[hit], names[hit]
        at = (first[:, None] + np.arange(width)).ravel()
        slot = (what[at] > 0) | (names[:, None] >> np.arange(width) & 1 > 0).ravel()
        vals = np.where(slot, value[at], np.uint64(0)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * width, pa.int32()), pa.array(vals))
        parts.append(pa.table([batch.column("__id").take(pa.array(text)), pa.array(np.full(len(first), width, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(first - begin[text]), pa.array(verbatim), pa.array(names > 0), lists], ["id", "width", "h", "pos", "verbatim", "other", "vals"]))
    return pa.concat_tables(parts).combine_chunks()


def _windows(df: DataFrame, id_col: str, text_col: str, widths: Sequence[int], whole: bool, bits: np.ndarray | None) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, "__text", STEP):
            yield from _rows(batch, widths, whole, sent.value).to_batches()

    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return texts.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, width int, h bigint, pos bigint, verbatim boolean, other boolean, vals array<bigint>")


def bit_field(hashes: DataFrame) -> np.ndarray:
    """The hashes' leading bits as a field of 2**24 bits; Spark merges them word by word."""
    cell = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = hashes.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(h, %d) & 63 AS INT))" % (64 - FILTER_BITS))).alias("b"))
    found = words.toArrow()  # at most 2**18 rows
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, item, n_windows`` (matching windows that count) and ``exact`` (in one run of them all
    slots have the item's own values), one row per document and item that match."""
    widths = range(SHORTEST, WIDTH + 1)
    items = stored(_windows(benchmark, item_col, item_text_col, widths, True, None), "item-windows")
    present = sorted(r[0] for r in items.select("width").distinct().collect())  # a few lengths
    found = _windows(docs, id_col, text_col, present, False, bit_field(items))
    found = found.drop("verbatim").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    items = items.select(F.col("id").alias("item"), F.col("h"), F.col("width"), F.col("pos").alias("item_pos"), "verbatim", F.col("other").alias("item_other"), F.col("vals").alias("item_vals"))
    items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    # The hash of a template covers the kind of every slot, so slots lie in the same places on both
    # sides. Where the values are equal, the document may read a slot as a word.
    theirs = F.when(F.col("verbatim"), F.col("item_vals")).otherwise(F.col("vals"))
    pairs = F.filter(F.arrays_zip(F.col("item_vals").alias("i"), theirs.alias("d")), lambda p: p["i"] != 0)
    met = found.join(items, ["h", "width", "salt"]).select("id", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "pos", pairs.alias("pairs"), (F.col("other") | F.col("item_other")).alias("other"))
    met = met.withColumn("own", F.forall("pairs", lambda p: p["i"] == p["d"]))
    alignment = Window.partitionBy("id", "item", "shift").orderBy("pos")  # an item's windows at most
    met = met.withColumn("cut", (F.col("pos") - F.lag("pos").over(alignment) >= WIDTH).cast("int")).withColumn("run", F.coalesce(F.sum("cut").over(alignment), F.lit(0)))
    runs = met.groupBy("id", "item", "shift", "run").agg(F.collect_set(F.struct("pos", "pairs", "own", "other")).alias("all"))

    def consistent(found: Column) -> Column:
        slots = F.array_distinct(F.flatten(F.transform(found, lambda w: w["pairs"])))
        return F.size(F.array_distinct(F.transform(slots, lambda p: p["i"]))) == F.size(slots)

    # A word read as a name vetoes nothing: without such readings the run may be consistent.
    plain, own = F.filter("all", lambda w: ~w["other"] | w["own"]), F.filter("all", lambda w: w["own"])
    kept = runs.select("id", "item", F.when(consistent(F.col("all")), F.col("all")).when(consistent(plain), plain).otherwise(own).alias("kept")).where(F.size("kept") > 0)
    counted = kept.select("id", "item", F.size(F.array_distinct("kept.pos")).alias("n"), F.forall("kept", lambda w: w["own"]).alias("exact"))
    out = counted.groupBy("id", "item").agg(F.sum("n").alias("n_windows"), F.max("exact").alias("exact"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_windows", "exact")
