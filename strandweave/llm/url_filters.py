"""URL filtering with a bit-parallel wildcard automaton (operator 2).

All glob rules are packed into one row of 64-bit words: a pattern of m literal
elements takes m+1 bits, bit j meaning "the first j elements are matched".
One step of the Shift-And automaton reads one byte of every URL of a batch:
``state' = ((state << 1) & literals[byte]) | (state & loops[byte])``, with a
carry between words, so every rule is simulated at once for all URLs.  A star
is a self-loop on its bit; a star in the host part does not loop on "/", so it
cannot run into the path.  The rule with the longest text among those whose
last bit is set at the end decides.

The canonical URL is the host (A-Z lower-cased) followed by the path; scheme,
query and fragment are dropped.  It is a map-only operator: no shuffle, and
memory bounded by one Arrow batch of hosts and paths.

Edge cases: a null URL or one without "://" has an empty host and path, fits
no rule and gets the default verdict; of fitting rules of equal length the
first in the list decides; repeated rows are judged alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import text as tx

_U = np.uint64


class Rule(NamedTuple):
    """``host/path`` prefix rule: fits the host and all its subdomains, and every path that starts with the path."""

    text: str
    verdict: str

    def globs(self) -> list[str]:
        return [f"{self.text}*", f"*.{self.text}*"]


class Automaton:
    """Shift-And masks of several globs; ``*`` any run of bytes, ``?`` any one byte (neither "/" in the host part)."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._elements(g) for g in globs]
        bits = sum(len(p[0]) + 1 for p in parsed)
        self.words = max(1, -(-bits // 64))
        self.literals = np.zeros((256, self.words), _U)
        self.loops = np.zeros((256, self.words), _U)
        self.first = np.zeros(self.words, _U)
        self.absorbing = np.zeros(self.words, _U)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for elements, stars in parsed:
            for j in range(len(elements) + 1):
                word, bit = divmod(at + j, 64)
                mask = _U(1) << _U(bit)
                if j == 0:
                    self.first[word] |= mask
                else:
                    self.literals[list(elements[j - 1]), word] |= mask
                if j in stars:
                    self.loops[list(stars[j]), word] |= mask
                if j == len(elements):
                    self.last.append((word, mask))
                    if len(stars.get(j, ())) == 256:
                        self.absorbing[word] |= mask
            at += len(elements) + 1

    @staticmethod
    def _elements(glob: str) -> tuple[list[frozenset[int]], dict[int, frozenset[int]]]:
        elements: list[frozenset[int]] = []
        stars: dict[int, frozenset[int]] = {}
        every, in_host = frozenset(range(256)), frozenset(range(256)) - {ord("/")}
        path = False
        for byte in glob.encode():
            if byte == ord("*"):
                stars[len(elements)] = every if path else in_host
            elif byte == ord("?"):
                elements.append(every if path else in_host)
            else:
                elements.append(frozenset([byte]))
                path |= byte == ord("/")
        return elements, stars

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts x globs) booleans: which globs fit each whole text."""
        n = len(offsets) - 1
        state = np.repeat(self.first[None, :], n, axis=0)
        lengths = np.diff(offsets)
        live = np.argsort(-lengths, kind="stable")
        live = live[: int((lengths > 0).sum())]
        step = 0
        while len(live):
            live = live[: int(np.searchsorted(-lengths[live], -step, side="left"))]
            byte = data[offsets[live] + step]
            now = state[live]
            shifted = now << _U(1)
            shifted[:, 1:] |= now[:, :-1] >> _U(63)
            now = (shifted & self.literals[byte]) | (now & self.loops[byte])
            state[live] = now
            step += 1
            if step % 32 == 0:  # rows that can no longer change
                live = live[((now & ~self.absorbing) != 0).any(axis=1)]
        return np.stack([(state[:, w] & m) != 0 for w, m in self.last], axis=1) if self.last else np.zeros((n, 0), bool)


def _judge(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], default: str) -> Iterator[pa.RecordBatch]:
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    ranked = [rules[i] for i in order]
    globs = [g for r in ranked for g in r.globs()]
    owner = np.repeat(np.arange(len(ranked)), [len(r.globs()) for r in ranked])
    automaton = Automaton(globs)
    texts = np.array([r.text for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [default], object)
    for batch in batches:
        for lo, hi, data, offsets in tx.slices(batch.column("canonical")):
            fits = automaton.match(data, offsets)
            best = np.where(fits, owner[None, :], len(ranked)).min(axis=1, initial=len(ranked))
            rows = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("host"), rows.column("path"), pa.array(texts[best], pa.string()), pa.array(verdicts[best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )


def host_and_path(url):
    """Columns of the host and the path of a URL column."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule (null where none fits), verdict."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.select("*", F.concat("host", "path").alias("canonical"))
    rules = list(rules)
    return tx.map_texts(urls, lambda it: _judge(it, rules, default), "page_id long, host string, path string, rule string, verdict string")


#: The rules of the query's contract.
RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)


def url_filter_query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


URL_FILTER_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""
