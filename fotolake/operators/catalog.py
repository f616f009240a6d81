"""The catalog: reading, statistics, worklists and changes, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.runtime import cut, skew_join
from fotolake.schema import LEDGER, MEDIA, META_VERSION, evolve

ALL, VISIBLE_ONLY = "all", "visible_only"
DERIVED = ("content_hash", "phash", "dom_color")


#: Rows without digest are spread over so many join keys; they match nothing.
NULL_PARTS = 4_096


def with_user_meta(media: DataFrame, user_meta: DataFrame) -> DataFrame:
    """Every media row with the user's fields of its content; an unknown content matches nothing.

    A null digest means "never needed" and may stand in half of all rows: those go to many tasks, not to the one of the null key.
    """
    u = user_meta.select("content_hash", "hidden", "rating", "kind", F.lit(0).cast("long").alias("_part"))
    part = F.when(F.col("content_hash").isNull(), F.pmod(F.xxhash64("path"), F.lit(NULL_PARTS))).otherwise(F.lit(0)).cast("long")
    joined = media.withColumn("_part", part).join(u, ["content_hash", "_part"], "left")
    return joined.select(*[c for c in media.columns], F.coalesce("hidden", F.lit(False)).alias("hidden"), m.clamp_rating("rating").alias("rating"), m.known_kind("kind").alias("kind"))


def present(media: DataFrame, user_meta: DataFrame, visibility: str, root: str | None = None) -> DataFrame:
    """Rows not missing, below `root` if given, without hidden ones unless `visibility` is ALL."""
    if visibility not in (ALL, VISIBLE_ONLY):
        raise ValueError(visibility)
    rows = media.where(~F.col("missing"))
    if root is not None:
        rows = rows.where(m.under(root))
    out = with_user_meta(rows, user_meta)
    return out if visibility == ALL else out.where(~F.col("hidden"))


def stamps(media: DataFrame, root: str | None = None) -> DataFrame:
    """What change detection needs of each row, missing ones included."""
    rows = media if root is None else media.where(m.under(root))
    return rows.select("id", "path", "size", "mtime", "meta_version", "missing", F.col("content_hash").isNotNull().alias("has_hash"), F.col("phash").isNotNull().alias("has_phash"))


def _stats() -> list[Column]:
    n = lambda c: F.count(c)
    return [n(F.lit(1)).alias("files"), n("content_hash").alias("hashed"), n("phash").alias("phashed"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes")]


def library_stats(media: DataFrame, root: str | None = None) -> DataFrame:
    rows = media.where(~F.col("missing"))
    return (rows if root is None else rows.where(m.under(root))).agg(*_stats())


def stats_by_folder(media: DataFrame) -> DataFrame:
    """Library statistics per top-level folder."""
    rows = media.where(~F.col("missing")).withColumn("folder", F.element_at(F.concat(m.path_order(), F.array(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"))), 3))
    return rows.groupBy("folder").agg(*_stats())


def hidden_count(media: DataFrame, user_meta: DataFrame, root: str | None = None) -> DataFrame:
    rows = media.where(~F.col("missing"))
    rows = rows if root is None else rows.where(m.under(root))
    return rows.join(user_meta.where("hidden").select("content_hash"), "content_hash", "left_semi").agg(F.count(F.lit(1)).alias("hidden"))


def colliding_sizes(media: DataFrame) -> DataFrame:
    """Sizes held by two or more present rows."""
    return media.where(~F.col("missing")).groupBy("size").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


def hash_worklist(media: DataFrame) -> DataFrame:
    """Present rows without digest whose size collides: only those can be exact duplicates."""
    todo = media.where(~F.col("missing") & F.col("content_hash").isNull())
    return todo.join(colliding_sizes(media).select("size"), "size", "left_semi").select("id", "path", "size")


def analysis_worklist(media: DataFrame) -> DataFrame:
    """Present decodable rows without perceptual hash or colour."""
    return media.where(~F.col("missing") & (F.col("phash").isNull() | F.col("dom_color").isNull()) & m.is_decodable_ext()).select("id", "path")


def tag_worklist(media: DataFrame, tagged: DataFrame) -> DataFrame:
    """Rows of `tagged(id)` without digest: what a rating, flag or kind is kept under must be known before it can be set."""
    return media.where(F.col("content_hash").isNull() & ~F.col("missing")).join(tagged.select("id").distinct(), "id", "left_semi").select("id", "path")


def point_lookup(user_meta: DataFrame, content_hash: str) -> DataFrame:
    """Rating and hidden flag of one content, defaults where nothing is known."""
    u = user_meta.where(F.col("content_hash") == content_hash)
    return u.agg(m.clamp_rating(F.max("rating")).alias("rating"), F.coalesce(F.max("hidden"), F.lit(False)).alias("hidden"))


# --- changes -------------------------------------------------------------------------------------


def classify_changes(listing: DataFrame, media: DataFrame, meta_version: int = META_VERSION) -> DataFrame:
    """path and change: new, changed, stale (older metadata, or back after being missing), unchanged, vanished.

    `listing(path, size, mtime)` is what stands on disk. A row already missing and still gone is `gone`.
    """
    new = listing.select("path", F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), F.lit(True).alias("on_disk"))
    old = media.select("id", "path", "size", "mtime", "meta_version", "missing")
    j = new.join(old, "path", "full_outer")
    same = F.col("n_size").eqNullSafe(F.col("size")) & F.col("n_mtime").eqNullSafe(F.col("mtime"))
    change = (
        F.when(F.col("id").isNull(), "new")
        .when(F.col("on_disk").isNull() & F.col("missing"), "gone")
        .when(F.col("on_disk").isNull(), "vanished")
        .when(~same, "changed")
        .when((F.col("meta_version") != meta_version) | F.col("missing"), "stale")
        .otherwise("unchanged")
    )
    return j.select("path", "id", change.alias("change"))


def index_outcome(changes: DataFrame, **done: DataFrame) -> DataFrame:
    """Counters of an index run, one row: scanned, updated, unchanged, missing (all rows gone, also from before), and the rows of each frame in `done` (hashed, analysed, thumbnails, errors)."""
    n = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    out = changes.agg(n("new", "changed", "stale", "unchanged").alias("scanned"), n("new", "changed", "stale").alias("updated"), n("unchanged").alias("unchanged"), n("vanished", "gone").alias("missing"))
    for name, rows in done.items():
        out = out.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return out


def upsert(media: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after `rows` (unique by path, columns of MEDIA but id) were written.

    What was computed from the bytes is kept where size and time are unchanged, dimensions too where
    the new row has none. New rows get ids above the highest so far, by path order.
    """
    old = evolve(media, MEDIA)
    new = evolve(rows.withColumn("id", F.lit(None).cast("long")) if "id" not in rows.columns else rows, MEDIA)
    n, o = new.alias("n"), old.alias("o")
    j = n.join(o, F.col("n.path") == F.col("o.path"), "full_outer")
    written = F.col("n.path").isNotNull()
    same = F.col("n.size").eqNullSafe(F.col("o.size")) & F.col("n.mtime").eqNullSafe(F.col("o.mtime")) & F.col("o.path").isNotNull()
    out = []
    for f in MEDIA.names:
        new_value, old_value = F.col(f"n.{f}"), F.col(f"o.{f}")
        if f == "id":
            value = old_value
        elif f == "missing":
            value = F.when(written, F.lit(False)).otherwise(old_value)
        elif f == "meta_version":
            value = F.when(written, F.lit(META_VERSION).cast("long")).otherwise(old_value)
        elif f in DERIVED:
            value = F.when(~written, old_value).when(same, old_value).otherwise(new_value)
        elif f in ("width", "height"):
            value = F.when(~written, old_value).when(same, F.coalesce(new_value, old_value)).otherwise(new_value)
        else:
            value = F.when(written, new_value).otherwise(old_value)
        out.append(value.alias(f))
    merged = j.select(*out)
    known, fresh = merged.where("id is not null"), merged.where("id is null")
    from fotolake.operators.ordering import global_rank

    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = global_rank(fresh, ["path"], "_k").crossJoin(F.broadcast(top))  # one row
    numbered = numbered.withColumn("id", F.col("_top") + F.col("_k"))
    return known.unionByName(numbered.select(*MEDIA.names))


def set_columns(media: DataFrame, updates: DataFrame, columns: tuple[str, ...], keep_known: bool = False) -> DataFrame:
    """Update `columns` by id; with `keep_known` a null leaves the old value."""
    u = updates.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = media.join(u, "id", "left")
    value = lambda c: F.when(F.col("_hit"), F.coalesce(f"_{c}", c) if keep_known else F.col(f"_{c}")).otherwise(F.col(c))
    return j.select(*[value(c).alias(c) if c in columns else F.col(c) for c in media.columns])


def mark_missing(media: DataFrame, seen_ids: DataFrame, root: str | None = None) -> DataFrame:
    """Flag rows below `root` that were not seen."""
    s = seen_ids.select("id").distinct().withColumn("_seen", F.lit(True))
    gone = F.col("_seen").isNull() & (m.under(root) if root is not None else F.lit(True))
    j = media.join(s, "id", "left")
    return j.select(*[F.when(gone, True).otherwise(F.col("missing")).alias("missing") if c == "missing" else F.col(c) for c in media.columns])


def purge_missing(media: DataFrame) -> DataFrame:
    return media.where(~F.col("missing"))


def remove_paths(media: DataFrame, paths: DataFrame) -> DataFrame:
    return media.join(paths.select("path").distinct(), "path", "left_anti").select(*media.columns)


def apply_moves(media: DataFrame, moves: DataFrame) -> DataFrame:
    """The table after files moved: `moves(src, dst)`, sources and targets unique, taken as one simultaneous step.

    A row standing at a target makes way unless it moves itself; unknown sources do nothing (their
    target's row stays). Chains (a to b, b to c) and exchanges thus keep every file.
    """
    mv = moves.where("src <> dst").select("src", "dst")
    live = mv.join(media.select(F.col("path").alias("src")), "src", "left_semi")
    j = media.join(live.select(F.col("src").alias("path"), F.col("dst").alias("_to")), "path", "left")
    j = j.join(live.select(F.col("dst").alias("path"), F.lit(True).alias("_hit")), "path", "left").where("_to is not null or _hit is null")
    to = F.col("_to")
    new = {"path": F.coalesce(to, "path"), "file_name": F.when(to.isNotNull(), m.file_name(to)).otherwise(F.col("file_name")), "ext": F.when(to.isNotNull(), m.extension(to)).otherwise(F.col("ext")), "missing": F.when(to.isNotNull(), False).otherwise(F.col("missing"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in media.columns])


def set_user_meta(user_meta: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """The user's fields after `edits(content_hash, ...)`: only the columns given are written, ratings clamped, unknown kinds cleared."""
    given = [c for c in ("hidden", "rating", "kind") if c in edits.columns]
    value = {"hidden": F.col("hidden").cast("boolean"), "rating": m.clamp_rating("rating"), "kind": m.known_kind("kind")} if given else {}
    e = edits.where("content_hash is not null").select("content_hash", *[value[c].alias(f"_{c}") for c in given], F.lit(True).alias("_hit"))
    j = user_meta.join(e, "content_hash", "full_outer")
    fresh = {"hidden": F.lit(False), "rating": F.lit(0).cast("tinyint"), "kind": F.lit(None).cast("string")}
    out = [F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in given else (F.coalesce(F.col(c), fresh[c]).alias(c)) for c in fresh]
    return j.select("content_hash", *out, F.when(F.col("_hit"), now).otherwise(F.col("updated_at")).cast("long").alias("updated_at"))


# --- removal ledger ------------------------------------------------------------------------------


def next_batch(ledger: DataFrame) -> DataFrame:
    """The next batch number and the latest batch with something to restore (null if none)."""
    return ledger.agg((F.coalesce(F.max("batch"), F.lit(0)) + 1).cast("long").alias("next_batch"), F.max(F.when(~F.col("restored"), F.col("batch"))).cast("long").alias("latest_restorable"))


def pending(ledger: DataFrame, batch: int | None = None) -> DataFrame:
    """Entries not restored; shown by falling id."""
    rows = ledger.where(~F.col("restored"))
    return rows if batch is None else rows.where(F.col("batch") == batch)


def record(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Append entries (batch, original_path, quarantine_path, moved_at), numbered on in path order."""
    from fotolake.operators.ordering import global_rank

    top = ledger.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    e = global_rank(entries, ["original_path"], "_k").crossJoin(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_k")).withColumn("restored", F.lit(False))
    return evolve(ledger, LEDGER).unionByName(evolve(e, LEDGER))


def mark_restored(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = ledger.join(hit, "id", "left")
    return j.select(*[(F.col("restored") | F.coalesce("_hit", F.lit(False))).alias("restored") if c == "restored" else F.col(c) for c in ledger.columns])


def _split_ext(target: str) -> tuple[Column, Column]:
    """(everything before the extension's dot, the extension or empty) of a path column."""
    ext = m.extension(F.col(target))
    base = F.when(ext == "", F.col(target)).otherwise(F.expr(f"left({target}, char_length({target}) - char_length(regexp_extract(substring_index({target}, '/', -1), '(?s)^.+\\\\.([^.]*)$', 1)) - 1)"))
    return base, ext


def _with_suffix(base: Column, ext: Column, number: Column) -> Column:
    return F.concat(base, F.lit("-"), number.cast("string"), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def unique_targets(rows: DataFrame, target: str, existing: DataFrame) -> DataFrame:
    """Add `dest`, which is neither in `existing(path)` nor the dest of another row (`rows` unique by path).

    The first row by path that wants a free target gets it. All others of a target get `stem-2.ext`,
    `stem-3.ext`... in path order, leaving out every number whose name exists or is wanted as it
    stands by some row. Rows without target get none.
    """
    from fotolake.operators.ordering import group_rank

    rows = cut(rows)
    there = existing.select(F.col("path").alias(target)).where(F.col(target).isNotNull()).distinct()
    first = rows.where(F.col(target).isNotNull()).groupBy(target).agg(F.min("path").alias("_first"))
    free = cut(first.join(there, target, "left_anti"))
    marked = skew_join(rows, free, target, "left")
    plain = F.col("_first").isNull() & F.col(target).isNull() | (F.col("_first") == F.col("path"))
    done = marked.where(F.coalesce(plain, F.lit(False))).select(*rows.columns, F.col(target).alias("dest"))
    rest = cut(marked.where(~F.coalesce(plain, F.lit(False))).select(*rows.columns))
    if rest.isEmpty():
        return done
    # names taken, told apart as target and number: one name belongs to one target only
    base, ext = _split_ext("_name")
    numbered = base.rlike("(?s)^.*-[1-9][0-9]{0,17}$")
    taken = there.select(F.col(target).alias("_name")).unionByName(rows.select(F.col(target).alias("_name"))).where(F.col("_name").isNotNull()).distinct()
    taken = taken.where(numbered).select(
        F.concat(F.regexp_extract(base, "(?s)^(.*)-[0-9]+$", 1), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))).alias(target), F.regexp_extract(base, "-([0-9]+)$", 1).cast("long").alias("_b")
    )
    taken = taken.where("_b >= 2").join(rest.select(target).distinct(), target, "left_semi")
    waiting = group_rank(rest.select(target, "path"), [target], ["path"], "_i")
    # before its j-th taken number b a target has b - 1 - j free ones: a row comes after those with fewer free ones than its place
    blocked = group_rank(taken, [target], ["_b"], "_j").select(target, F.lit(None).cast("string").alias("path"), (F.col("_b") - 1 - F.col("_j")).alias("_i"), F.lit(1).alias("_taken"))
    events = waiting.withColumn("_taken", F.lit(0)).unionByName(blocked)
    spot = group_rank(events, [target], ["_i", "_taken", "path"], "_k").where("_taken = 0").select("path", "_k")
    base, ext = _split_ext(target)
    named = rest.join(spot, "path").select(*rows.columns, _with_suffix(base, ext, F.col("_k") + 1).alias("dest"))
    return done.unionByName(named)
