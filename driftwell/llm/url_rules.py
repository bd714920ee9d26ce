"""URL filter: all glob rules at once in a bit-parallel automaton.

A rule is a host and a path prefix. It becomes a glob over the canonical URL, which is a dot,
the lower-cased host and the path: ``*.example.org/es/**``. ``*`` stands for any bytes but ``/``,
``**`` for any bytes, ``?`` for one byte but ``/``. All globs lie side by side in one bit string of
as many 64-bit words as needed. One step per byte moves every glob of every URL: a shift with
carry, a mask of the places that this byte may enter, and a mask of the places that may stay.

Defined cases: a null URL or one without ``://`` has an empty host and path and fits no rule; a
null page id stays null; repeated rows are judged one by one; rules of equal length keep the
order they are given in; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import byte_view, in_steps


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class Automaton:
    """Masks by byte (256 rows) and by 64-bit word (columns)."""

    enter: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    final: np.ndarray
    settled: np.ndarray  # places that are never left again
    accepts: tuple[int, ...]  # the accepting place of each glob

    def run(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row per text, one column per glob: does the glob fit the whole text?"""
        n, words = len(offsets) - 1, self.enter.shape[1]
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, left = offsets[:-1][order], lengths[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        live, at = np.arange(n), 0
        while True:
            live = live[: np.searchsorted(-left[live], -at, side="left")]  # texts longer than `at`
            if at % 32 == 0 and len(live):  # texts whose answer can't change any more are done
                live = live[((state[live] & ~self.settled) != 0).any(axis=1)]
            if not len(live):
                break
            byte, now = data[begin[live] + at], state[live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live] = (moved & self.enter[byte]) | (now & self.stay[byte])
            at += 1
        place = np.array(self.accepts, dtype=np.int64)
        fits = (state[:, place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)
        out = np.zeros((n, len(place)), dtype=bool)
        out[order] = fits.astype(bool)
        return out.reshape(n, words and len(place))


def compile_globs(globs: Sequence[str]) -> Automaton:
    steps: list[tuple[int, np.ndarray]] = []  # place, bytes that may enter it
    loops: list[tuple[int, np.ndarray]] = []  # place, bytes that may stay in it
    starts, accepts, place = [], [], 0
    no_slash = np.ones(256, dtype=bool)
    no_slash[ord("/")] = False
    for glob in globs:
        starts.append(place)
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i : i + 2] == b"**":
                loops.append((place, np.ones(256, dtype=bool)))
                i += 2
            elif raw[i] == ord("*"):
                loops.append((place, no_slash))
                i += 1
            else:
                place += 1
                steps.append((place, no_slash if raw[i] == ord("?") else np.arange(256) == raw[i]))
                i += 1
        accepts.append(place)
        place += 1
    words = max(1, -(-place // 64))
    enter, stay = np.zeros((256, words), dtype=np.uint64), np.zeros((256, words), dtype=np.uint64)
    for masks, rows in ((enter, steps), (stay, loops)):
        for at, allowed in rows:
            masks[allowed, at // 64] |= np.uint64(1 << at % 64)
    start, final = np.zeros(words, dtype=np.uint64), np.zeros(words, dtype=np.uint64)
    for masks, places in ((start, starts), (final, accepts)):
        for at in places:
            masks[at // 64] |= np.uint64(1 << at % 64)
    return Automaton(enter, stay, start, final, final & np.bitwise_and.reduce(stay, axis=0), tuple(accepts))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), after


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``otherwise`` is the verdict where no rule fits."""
    ranked = sorted(rules, key=lambda r: -len(r.name))
    machine = compile_globs([r.glob for r in ranked])
    names = np.array([*(r.name for r in ranked), None], dtype=object)
    verdicts = np.array([*(r.verdict for r in ranked), otherwise], dtype=object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches, "canonical"):
            data, offsets = byte_view(batch.column("canonical"))
            fits = machine.run(data, offsets)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if ranked else np.zeros(batch.num_rows, dtype=int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("host"), batch.column("path"), pa.array(names[best], pa.string()), pa.array(verdicts[best], pa.string())],
                [id_col, "host", "path", "rule", "verdict"],
            )

    urls = pages.select(F.col(id_col), F.col(url_col).alias("__url"))
    host, path = split_url(F.col("__url"))
    parts = urls.select(id_col, host.alias("host"), path.alias("path")).withColumn("canonical", F.concat(F.lit("."), "host", "path"))
    kind = dict(pages.dtypes)[id_col]
    return parts.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
