"""Evaluation items leaking into documents: rare n-gram seeds, then Smith-Waterman alignment.

Every run of `run` words of an item has a seed: its rarest n-gram, by the number of documents that
hold it. A document sharing the run holds that seed, so seeds lose nothing, and phrases found
everywhere seed only where nothing rarer exists. For edited copies the rarest word pairs of the
item are seeds too, one more than an alignment of the wanted score can break, so each such copy
holds one of them, however many documents do. Seeds join documents to items; around them the two
texts are aligned word by word, which scores edited copies and measures the longest exact run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotolake.runtime import cut, filter_bits, maybe_in, skew_join

WORD = re.compile(r"[^\W_]+")
#: Words in a seed, and the exact run that makes a leak.
SEED_WORDS, RUN_WORDS = 5, 13
#: The similarity from which edited copies are found, unless given.
LEAST = 0.75
MATCH, MISMATCH, GAP = 2, -1, -1
#: N-grams of items sent to the workers at most (about 100 bytes each there); beyond that a filter of MOST_BITS bits at most
#: tells which n-grams of a document may be an item's, and those are joined by shuffle.
BROADCAST_GRAMS = 200_000
#: Items judged against one copy of a document's text.
ITEMS_PER_TEXT = 1_000


def words(text: str | None) -> list[str]:
    """The longest runs of letters or digits of the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def gram_hash(ws: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(ws)) - (1 << 63)


def item_classes(items: DataFrame) -> DataFrame:
    """Distinct item word sequences: words, cls (the smallest item id), item_ids."""

    def read(batches):
        for pdf in batches:
            ws = [words(t) for t in pdf["text"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [" ".join(w) for w in ws]})

    read_items = items.select("item_id", "text").where("item_id is not null and text is not null").mapInPandas(read, "item_id long, words string").where("words <> ''")
    return read_items.groupBy("words").agg(F.min("item_id").alias("cls"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def edits(n: int, least: float) -> int:
    """The most an alignment of at least `least` with an item of n words can lose of the full score.

    Each pair of neighbouring item words it breaks costs 1 or more, each item word it leaves unmatched
    2 or more (at an end; 3 inside): so at most `edits` pairs are broken and `edits` // 2 words missing.
    """
    return MATCH * n - math.ceil(MATCH * n * least - 1e-9)


def _grams(classes: DataFrame, n: int, least: float | None) -> DataFrame:
    """cls, kind, pos, gram, phrase, take.

    kind 'run': n-grams; items under n words give one shorter n-gram. kind 'edit': word pairs, or
    single words where all pairs may be broken, of which the `take` rarest are seeds.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for c, text in zip(pdf["cls"], pdf["words"]):
                ws = text.split(" ")
                kinds = [("run", min(n, len(ws)), 0)]
                if least is not None:
                    e = edits(len(ws), least)
                    kinds.append(("edit", 2, e + 1) if len(ws) - 1 > e else ("edit", 1, e // 2 + 1))
                for kind, k, take in kinds:
                    out += [(c, kind, i, gram_hash(ws[i : i + k]), " ".join(ws[i : i + k]), take) for i in range(len(ws) - k + 1)]
            yield pd.DataFrame(out, columns=["cls", "kind", "pos", "gram", "phrase", "take"])

    return classes.select("cls", "words").mapInPandas(run, "cls long, kind string, pos int, gram long, phrase string, take int")


def _by_size(phrases) -> tuple[dict[int, set[str]], set[str]]:
    """The phrases by their number of words, and all their words."""
    table: dict[int, set[str]] = {}
    for p in phrases:
        table.setdefault(p.count(" ") + 1, set()).add(p)
    return table, {w for p in phrases for w in p.split(" ")}


def _hits(ws: list[str], table: dict[int, set[str]], known: set[str]) -> Iterator[tuple[str, int]]:
    """(phrase, place) of all phrases of the table in a document."""
    # starts of n words in a row that all occur in the phrases
    c = np.concatenate(([0], np.cumsum(np.fromiter(map(known.__contains__, ws), bool, len(ws)))))
    for n, wanted in table.items():
        if len(ws) < n:
            continue
        for i in np.nonzero(c[n:] - c[:-n] == n)[0].tolist():
            p = " ".join(ws[i : i + n])
            if p in wanted:
                yield p, i


def _readable(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where("text is not null and doc_id is not null")


def _count(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """gram, df: how many document rows hold each of the phrases."""
    table, known = _by_size(phrases)

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            df = Counter()
            for text in pdf["text"]:
                df.update({p for p, _ in _hits(words(text), table, known)})
            yield pd.DataFrame({"gram": np.array([gram_hash(p.split(" ")) for p in df], np.int64), "df": np.array(list(df.values()), np.int64)})

    return _readable(docs).mapInPandas(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def _gram_filter(grams: DataFrame) -> bytes:
    """A bitmap over the n-grams of the items, sized by their number and at most MOST_BITS (16 MB); each n-gram sets one bit."""
    bits = filter_bits(grams.count())
    spot = grams.select(F.pmod("gram", F.lit(bits)).alias("s"))
    words_set = spot.groupBy(F.expr("s div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v")).toArrow()  # bounded by the bitmap
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[words_set["at"].to_numpy()] = words_set["v"].to_numpy()
    return bitmap.tobytes()


def _scan_all(docs: DataFrame, grams: DataFrame, n: int) -> DataFrame:
    """(gram, doc_id) for the items' n-grams in each document, by shuffle, for item sets too large to broadcast.

    What the filter rules out never leaves the task that reads the text: about one in twelve other n-grams does.
    """
    wanted = cut(grams.select("gram").distinct())
    held = docs.sparkSession.sparkContext.broadcast(_gram_filter(wanted))
    sizes = sorted({r[0] for r in grams.select(F.size(F.split("phrase", " "))).distinct().collect()})  # 1 to n

    def run(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for pdf in batches:
            gs, ds = [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ws = words(text)
                every = np.unique(np.fromiter((gram_hash(ws[i : i + k]) for k in sizes for i in range(len(ws) - k + 1)), np.int64))
                spot = every % (8 * len(bits))
                may = every[(bits[spot // 8] >> (spot % 8).astype(np.uint8)) & 1 > 0]
                gs.append(may)
                ds.append(np.full(len(may), doc, np.int64))
            yield pd.DataFrame({"gram": np.concatenate(gs) if gs else np.empty(0, np.int64), "doc_id": np.concatenate(ds) if ds else np.empty(0, np.int64)})

    every = _readable(docs).mapInPandas(run, "gram long, doc_id long")
    return skew_join(cut(every), wanted, "gram", "left_semi")


def seeds(grams: DataFrame, frequency: DataFrame, n: int, run: int) -> DataFrame:
    """Per item the rarest n-gram of every window of `run` words (of the whole item if shorter), and its rarest pairs: cls, kind, gram."""
    g = grams.join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    last = Window.partitionBy("cls").orderBy("pos").rowsBetween(0, run - n)
    whole = Window.partitionBy("cls")
    # an n-gram no document holds can't seed; edited copies may still hold the next rarest
    pick = F.min(F.when(F.col("df") > 0, F.struct("df", "gram"))).over(last)
    r = g.where("kind = 'run'").withColumn("pick", pick).withColumn("top", F.max("pos").over(whole))
    # windows that reach past the item's end are parts of the last full one
    rarest = r.where((F.col("pos") <= F.greatest(F.col("top") - (run - n), F.lit(0)))).select("cls", "kind", F.col("pick.gram").alias("gram")).where("gram is not null")
    # places, not distinct pairs, are counted; one in no document is broken in all of them
    e = g.where("kind = 'edit'").withColumn("rank", F.row_number().over(whole.orderBy("df", "gram", "pos")))
    return rarest.unionByName(e.where("rank <= take and df > 0").select("cls", "kind", "gram")).distinct()


def align(item: list[str], doc: list[str]) -> tuple[int, int]:
    """Best local alignment score of two word lists, and the length of their longest common run of words."""
    if not item or not doc:
        return 0, 0
    ids: dict[str, int] = {}
    a = [ids.setdefault(w, len(ids)) for w in item]
    b = np.array([ids.get(w, -1) for w in doc])
    h = np.zeros(len(b) + 1, np.int64)
    runs = np.zeros(len(b) + 1, np.int64)
    ramp = np.arange(len(b) + 1) * -GAP
    score = longest = 0
    for w in a:
        eq = b == w
        runs[1:] = (runs[:-1] + 1) * eq
        new = np.maximum(h + GAP, 0)
        np.maximum(new[1:], h[:-1] + np.where(eq, MATCH, MISMATCH), out=new[1:])
        # gaps along the document: a running maximum, discounted by distance
        h = np.maximum.accumulate(new + ramp) - ramp
        score, longest = max(score, int(h.max())), max(longest, int(runs.max()))
    return score, longest


def _regions(doc: list[str], wanted: set[str], sizes: set[int], reach: int) -> list[tuple[int, int]]:
    """Word ranges around the seeds, wide enough for the item on either side; overlapping ones joined."""
    hits = sorted({i for n in sizes for i in range(len(doc) - n + 1) if " ".join(doc[i : i + n]) in wanted})
    out: list[list[int]] = []
    for i in hits:
        a, b = max(0, i - reach), min(len(doc), i + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Item:
    """An item's words, its seeds and n-grams, and what a copy edited no more than allowed must keep."""

    def __init__(self, text: str, wanted: set[str], n: int, least: float | None):
        self.words, self.n, self.least = text.split(" "), n, least
        k = min(n, len(self.words))
        self.wanted = wanted | {" ".join(self.words[i : i + k]) for i in range(len(self.words) - k + 1)}
        self.sizes = {p.count(" ") + 1 for p in self.wanted}
        self.pairs = list(zip(self.words, self.words[1:]))
        self.edits = 0 if least is None else edits(len(self.words), least)

    def may_align(self, doc: list[str]) -> bool:
        """Whether so many words and pairs of the item are there that it may align over `least`."""
        if self.least is None:
            return False
        have = set(doc)
        if sum(w in have for w in self.words) < len(self.words) - self.edits // 2:
            return False
        pairs = set(zip(doc, doc[1:]))
        return sum(p in pairs for p in self.pairs) >= len(self.pairs) - self.edits

    def judge(self, doc: list[str], run_seed: bool) -> tuple[int, int] | None:
        """Score and longest run in a document with a seed; None if neither a run's seed nor the score makes a row."""
        if not run_seed and not self.may_align(doc):
            return None
        score = longest = 0
        for a, b in _regions(doc, self.wanted, self.sizes, 2 * len(self.words) + self.n):
            part = doc[a:b]
            if run_seed or self.may_align(part):
                s, r = align(self.words, part)
                score, longest = max(score, s), max(longest, r)
        return (score, longest) if run_seed or score >= MATCH * len(self.words) - self.edits else None


def leaked_items(items: DataFrame, docs: DataFrame, *, n: int = SEED_WORDS, run: int = RUN_WORDS, least: float | None = LEAST) -> DataFrame:
    """Items with the documents they may have leaked into: item_id, doc_id, item_words, longest_run, score, similarity.

    A row for each item and document that share a seed of `run` words, or align over at least `least`
    of the item (None: only the former). `similarity` is the alignment score over that of the whole item;
    runs under n words are measured around seeds only. Null or empty texts and null ids give no rows;
    repeated questions under other ids each give rows; repeated rows count once. Items shorter than `run`
    words are judged as a whole. Empty tables give no rows; extra columns are ignored.
    """
    classes = cut(item_classes(items))
    grams = cut(_grams(classes, n, least))
    columns = ["item_ids", "doc_id", "item_words", "longest_run", "score", "similarity"]
    schema = "item_ids array<long>, doc_id long, item_words int, longest_run int, score int, similarity double"
    phrase_of = grams.select("cls", "kind", "gram", "phrase").distinct()

    def row(ids, doc, item: Item, got: tuple[int, int]):
        return (list(ids), doc, len(item.words), got[1], got[0], got[0] / (MATCH * len(item.words)))

    if grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        frequency = _count(docs, [r.phrase for r in grams.select("phrase").distinct().collect()])
        chosen = seeds(grams, frequency, n, run).join(phrase_of, ["cls", "kind", "gram"])
        # no more than the n-grams counted above
        at: dict[str, list[tuple[int, bool]]] = {}
        wanted: dict[int, set[str]] = {}
        for r in chosen.collect():
            at.setdefault(r.phrase, []).append((r.cls, r.kind == "run"))
            wanted.setdefault(r.cls, set()).add(r.phrase)
        known_items = {r.cls: (r.words, list(r.item_ids)) for r in classes.collect() if r.cls in wanted}

        def judge_docs(batches):
            table, known = _by_size(list(at))
            made = {c: Item(text, wanted[c], n, least) for c, (text, _) in known_items.items()}
            for pdf in batches:
                rows = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    dw = words(text)
                    cand: dict[int, bool] = {}
                    for p in {p for p, _ in _hits(dw, table, known)}:
                        for c, is_run in at[p]:
                            cand[c] = cand.get(c, False) or is_run
                    for c, is_run in cand.items():
                        if got := made[c].judge(dw, is_run):
                            rows.append(row(known_items[c][1], doc, made[c], got))
                yield pd.DataFrame(rows, columns=columns)

        judged = _readable(docs).mapInPandas(judge_docs, schema)
    else:
        found = cut(_scan_all(docs, grams, n).distinct())
        frequency = found.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        chosen = cut(seeds(grams, frequency, n, run))
        by_gram = cut(chosen.groupBy("gram").agg(F.collect_set(F.struct("cls", (F.col("kind") == "run").alias("is_run"))).alias("items")))
        cand = skew_join(found, by_gram, "gram").select("doc_id", F.explode("items").alias("i")).groupBy("doc_id", F.col("i.cls").alias("cls")).agg(F.max("i.is_run").alias("is_run"))
        cand = cut(cand)
        # an item may be in a third of all documents: ids meet items, and each text moves once for every ITEMS_PER_TEXT items it may hold
        small = chosen.join(phrase_of, ["cls", "kind", "gram"]).groupBy("cls").agg(F.collect_set("phrase").alias("seeds"))
        item = cut(classes.select("cls", "words", "item_ids").join(small, "cls"))
        parts = cand.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(ITEMS_PER_TEXT)).alias("_parts"))
        placed = skew_join(cand, item, "cls").join(parts, "doc_id").withColumn("_part", F.pmod(F.xxhash64("cls"), F.col("_parts")))
        packed = cut(placed.groupBy("doc_id", "_part").agg(F.collect_list(F.struct("words", "item_ids", "seeds", "is_run")).alias("items")))
        ready = maybe_in(_readable(docs), cut(packed.select("doc_id").distinct()), "doc_id").join(packed, "doc_id").select("doc_id", "text", "items")

        def judge_pairs(batches):
            for pdf in batches:
                rows = []
                for doc, text, items in zip(pdf["doc_id"], pdf["text"], pdf["items"]):
                    dw = words(text)
                    for i in items:
                        it = Item(i["words"], set(i["seeds"]), n, least)
                        if got := it.judge(dw, bool(i["is_run"])):
                            rows.append(row(i["item_ids"], doc, it, got))
                yield pd.DataFrame(rows, columns=columns)

        judged = ready.mapInPandas(judge_pairs, schema)
    return judged.select(F.explode("item_ids").alias("item_id"), *columns[1:]).distinct()
