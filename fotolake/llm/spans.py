"""Long exact spans shared between documents, located with repeated-phrase automata.

Half as long as a span must be, phrases are sampled from each text by winnowing: of all phrases
inside any span the same ones are chosen, wherever it stands, so two documents that share a span
share a sampled phrase. Phrases found in two or more documents recur. The documents that hold them
are spread over shards; each shard compiles an Aho-Corasick automaton of just its documents' phrases
and streams its documents through it, which locates every occurrence. Around the occurrences all
windows of the full length are compared across documents, by two independent 64-bit hashes; what is
covered by a window that stands in another document is shared.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotolake.runtime import HEAVY_PARTS, cut, maybe_in, skew_join

MIN_CHARS = 300
#: Characters of text aimed at per shard, and of a phrase's head that goes into an automaton (the rest is compared).
SHARD_CHARS, HEAD_CHARS = 2_000_000, 32
#: Shards up to which the rows of one window, one per shard, are few enough for a task (about 4 MB).
MANY_SHARDS = 100_000
#: Two independent bases of rolling hashes: phrases go by the first, windows by both (128 bits).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get(base, (0,))[0] < n:
        m = max(n, 1 << 14)
        up, down = (np.concatenate((np.ones(1, np.uint64), np.full(m, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64)))
        with np.errstate(over="ignore"):
            _POWERS[base] = m, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[base][1:]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Rolling:
    """64-bit hashes of any windows of a text, equal for equal windows wherever they stand; `base` is odd."""

    def __init__(self, points: np.ndarray, base: int = BASES[0]):
        up, self.down = _powers(base, len(points))
        with np.errstate(over="ignore"):
            terms = _mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)]
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def windows(self, size: int, starts: np.ndarray | None = None) -> np.ndarray:
        with np.errstate(over="ignore"):
            if starts is None:
                d = self.sums[size:] - self.sums[:-size]
                return _mix(d * self.down[: len(d)])
            return _mix((self.sums[starts + size] - self.sums[starts]) * self.down[starts])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row, in linear time (block prefixes and suffixes)."""
    n = len(h)
    pad = -n % w
    full = np.concatenate((h, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def sampled(text: str, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed k-phrases: every window of `size` characters holds one, chosen by the window's content alone."""
    if len(text) < size:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = Rolling(code_points(text)).windows(k)
    w = size - k + 1
    low = sliding_min(h, w)
    # a phrase is chosen if it is the least of some window around it: the least of the windows' least
    at = np.nonzero(h == _around(low, len(h), w))[0]
    return at, h[at]


def _around(low: np.ndarray, n: int, w: int) -> np.ndarray:
    """For each phrase the greatest of the minima of the windows that hold it; it is chosen where it equals that."""
    big = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    return ~sliding_min(~big, w)[:n]


def _phrases(docs: DataFrame, size: int, k: int) -> DataFrame:
    """The distinct sampled phrases of each document."""

    def run(batches):
        for pdf in batches:
            kept = [np.unique(sampled(text, size, k)[1]).view(np.int64) for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "phrases": kept})

    return docs.mapInPandas(run, "doc_id long, phrases array<long>")


def _spread(starts: np.ndarray, lo: int, hi: int, limit: int) -> np.ndarray:
    """All integers in the union of [s - lo, s + hi], within 0..limit."""
    mark = np.zeros(limit + 2, np.int64)
    a, b = np.clip(starts - lo, 0, limit + 1), np.clip(starts + hi + 1, 0, limit + 1)
    np.add.at(mark, a, 1)
    np.add.at(mark, b, -1)
    return np.nonzero(np.cumsum(mark)[: limit + 1] > 0)[0]


def _as_runs(starts: np.ndarray) -> np.ndarray:
    """Rising integers as (first, count) of each stretch without gaps."""
    first = np.nonzero(np.concatenate(([True], np.diff(starts) != 1)))[0]
    return np.stack([starts[first], np.diff(np.append(first, len(starts)))], axis=1).astype(np.int64)


def _from_runs(runs: bytes) -> np.ndarray:
    pairs = np.frombuffer(runs, np.int64).reshape(-1, 2)
    return np.concatenate([np.arange(a, a + n) for a, n in pairs])


def _locate(size: int, k: int):
    """One shard: an automaton of its documents' recurring phrases, and the windows around all occurrences."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads: dict[str, set[str]] = {}
        for text, known in zip(pdf["text"], pdf["phrases"]):
            at, h = sampled(text, size, k)
            for p in at[np.isin(h.view(np.int64), np.asarray(known, np.int64))].tolist():
                heads.setdefault(text[p : p + HEAD_CHARS], set()).add(text[p : p + k])
        auto = ahocorasick.Automaton()
        for head, whole in heads.items():
            auto.add_word(head, (len(head), tuple(whole)))
        auto.make_automaton()
        out = {"doc_id": [], "text": [], "runs": []}
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            hits = []
            for end, (n, whole) in auto.iter(text):
                p = end - n + 1
                if text[p : p + k] in whole:
                    hits.append(p)
            if hits:
                out["doc_id"].append(doc)
                out["text"].append(text)
                out["runs"].append(_as_runs(_spread(np.array(hits, np.int64), size - k, 0, len(text) - size)).tobytes())
        return pd.DataFrame({"shard": int(pdf["shard"].iloc[0]), **out})

    return run


def _hashed(pdf: pd.DataFrame, size: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, starts, both hashes) of the windows of each document."""
    out = []
    for doc, text, runs in zip(pdf["doc_id"], pdf["text"], pdf["runs"]):
        starts, points = _from_runs(runs), code_points(text)
        out.append((doc, starts, *[Rolling(points, base).windows(size, starts).view(np.int64) for base in BASES]))
    return out


def _windows_by_doc(docs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of one shard, rising, and whether two or more of its documents have each."""
    if not docs:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, bool)
    h1, h2 = (np.concatenate([d[i] for d in docs]) for i in (2, 3))
    doc = np.repeat(np.array([d[0] for d in docs], np.int64), [len(d[1]) for d in docs])
    by = np.lexsort((doc, h2, h1))
    h1, h2, doc = h1[by], h2[by], doc[by]
    first = np.nonzero(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))))[0]
    last = np.concatenate((first[1:], [len(h1)])) - 1
    return h1[first], h2[first], doc[first] != doc[last]


def _distinct_windows(size: int):
    """The distinct windows of each shard. A shard's rows stand together in one partition, as they were written."""

    def made(parts: list[pd.DataFrame]) -> pd.DataFrame:
        held = pd.concat(parts, ignore_index=True)
        h1, h2, several = _windows_by_doc(_hashed(held, size))
        return pd.DataFrame({"shard": int(held["shard"].iloc[0]), "w1": h1, "w2": h2, "several": several})

    def run(batches):
        parts: list[pd.DataFrame] = []
        for pdf in batches:
            for shard, rows in pdf.groupby("shard", sort=False):
                if parts and parts[0]["shard"].iloc[0] != shard:
                    yield made(parts)
                    parts = []
                parts.append(rows)
        if parts:
            yield made(parts)

    return run


def among(h1: np.ndarray, h2: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
    """Which pairs (h1, h2) are among the pairs (w1, w2), which rise by w1."""
    found = np.zeros(len(h1), bool)
    at = np.searchsorted(w1, h1)
    todo = np.arange(len(h1))
    while len(todo := todo[at[todo] < len(w1)]) and len(todo := todo[w1[at[todo]] == h1[todo]]):
        found[todo] |= w2[at[todo]] == h2[todo]
        at[todo] += 1  # another window may share the first half
        todo = todo[~found[todo]]
    return found


def _cover(size: int):
    def run(key, held: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        docs = _hashed(held, size)
        w1, w2, several = _windows_by_doc(docs)
        w1, w2 = w1[several], w2[several]
        if len(elsewhere):
            w1, w2 = (np.concatenate((w, elsewhere[c].to_numpy(np.int64))) for w, c in ((w1, "w1"), (w2, "w2")))
        by = np.argsort(w1, kind="stable")  # once for all documents of the shard
        w1, w2 = w1[by], w2[by]
        ids, chars = [], []
        for doc, starts, h1, h2 in docs:
            on = starts[among(h1, h2, w1, w2)]
            if len(on):
                # windows begin at rising places: each adds what the one before left open
                ids.append(doc)
                chars.append(int(size + np.minimum(np.diff(on), size).sum()))
        return pd.DataFrame({"doc_id": np.array(ids, np.int64), "shared_chars": np.array(chars, np.int64)})

    return run


def _elsewhere(windows: DataFrame, shards: int) -> DataFrame:
    """Windows held by two or more shards, for each shard that needs to be told: shard, w1, w2.

    A window has at most a row per shard. Up to MANY_SHARDS that bounds the rows of a window in a
    task; beyond, windows are aggregated with partial results, so that a passage in all shards is
    one row: its first and last shard come with it, and only windows of more shards need the rows again.
    """
    if shards <= MANY_SHARDS:
        everywhere = Window.partitionBy("w1", "w2")
        return windows.withColumn("_n", F.count(F.lit(1)).over(everywhere)).where("_n > 1 and not several").select("shard", "w1", "w2")
    met = windows.groupBy("w1", "w2").agg(F.min("shard").alias("lo"), F.max("shard").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    met = cut(met)
    ends = met.select(F.explode(F.array("lo", "hi")).alias("shard"), "w1", "w2")
    window = F.struct("w1", "w2").alias("window")
    more = cut(met.where("n > 2").select(window))
    if more.isEmpty():
        return ends
    rows = cut(maybe_in(windows.where("not several").select("shard", window), more, "window"))
    rest = skew_join(rows, more, "window", "left_semi").select("shard", "window.w1", "window.w2")
    return ends.unionByName(rest)


def shared_spans(docs: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """Characters of each document that lie in a stretch of `min_chars` or more which another document also has: doc_id, shared_chars.

    Texts are compared letter for letter, whole, in code points. Only documents with such characters
    give a row; null ids and null, empty or shorter texts give none; a stretch repeated inside one
    document only doesn't count; repeated rows are one document. Empty tables give no rows; extra
    columns are ignored.
    """
    k = max(1, min_chars // 2)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"doc_id is not null and char_length(text) >= {int(min_chars)}")
    found = cut(_phrases(d, min_chars, k))
    phrases = found.select("doc_id", F.explode("phrases").alias("phrase"))
    counted = phrases.groupBy("phrase").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    recurring = cut(counted.where("lo < hi").select("phrase", "n"))
    least = max(1_000, (found.agg(F.sum(F.size("phrases"))).first()[0] or 0) // HEAVY_PARTS)
    known = maybe_in(phrases, recurring.select("phrase"), "phrase")  # most phrases stand in one document only
    hits = skew_join(known, recurring.select("phrase"), "phrase", "left_semi", heavy=recurring.where(F.col("n") > least))
    per_doc = cut(hits.groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases")))  # a document's own phrases: under 2 % of its length
    # texts without recurring phrases are sorted out before any text is shuffled
    texts = maybe_in(d, per_doc, "doc_id").join(per_doc, "doc_id").dropDuplicates(["doc_id"])
    total = maybe_in(d.select("doc_id", F.char_length("text").alias("_n")), per_doc, "doc_id").join(per_doc.select("doc_id"), "doc_id", "left_semi").agg(F.sum("_n")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_CHARS))
    texts = texts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    located = cut(texts.groupBy("shard").applyInPandas(_locate(min_chars, k), "shard int, doc_id long, text string, runs binary"))
    # a window is one row per shard at most, however many documents have it. A document is in one
    # shard, so a window in two shards is in two documents; what a shard has twice it knows itself.
    windows = located.mapInPandas(_distinct_windows(min_chars), "shard int, w1 long, w2 long, several boolean")
    shared = _elsewhere(windows, shards)
    schema = "doc_id long, shared_chars long"
    return located.groupBy("shard").cogroup(shared.groupBy("shard")).applyInPandas(_cover(min_chars), schema)
