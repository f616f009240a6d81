"""Queries over the catalog itself, with their SQL.

The catalog is the `media` table, repeated rows once. The user's fields come from `documents`: each
document written about a picture counts as a star (up to five) for that picture's content, a question
about it hides it, a manual files it as saved. The disk listing is what `file_meta` and `incoming`
report. The removal ledger holds the non-keepers of exact groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.operators import catalog as c
from fotolake.operators import dupes as d
from fotolake.operators import ordering as o
from fotolake.operators.similarity import hamming_pairs
from fotolake.plans import indexing, rename
from fotolake.runtime import table
from fotolake.schema import MEDIA

ROOT = "/lib/Phone"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _media(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The catalog, repeated rows once; only the columns named (the id among them) are read and shuffled for it."""
    return table(spark, sf, "media").select(*(columns or MEDIA.names)).distinct()


def _user_meta(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "media_id", "doc_kind", "created_at")
    by = docs.join(_media(spark, sf, "id", "content_hash").withColumnRenamed("id", "media_id"), "media_id").where("content_hash is not null")
    kind = F.when(F.max((F.col("doc_kind") == "manual").cast("int")) == 1, "saved")
    return by.groupBy("content_hash").agg(
        F.coalesce(F.max(F.col("doc_kind") == "question"), F.lit(False)).alias("hidden"), F.least(F.count(F.lit(1)), F.lit(5)).cast("tinyint").alias("rating"), kind.alias("kind"),
        F.max(F.unix_seconds(F.col("created_at").cast("timestamp"))).alias("updated_at"),
    )


def _present(spark: SparkSession, sf: str, visibility: str = c.ALL, columns: tuple[str, ...] = ()) -> DataFrame:
    """Present rows with the user's fields; `columns` beside those that needs, or all."""
    need = [*dict.fromkeys(("id", "path", "content_hash", "missing", *columns))] if columns else []
    return c.present(_media(spark, sf, *need), _user_meta(spark, sf), visibility)


_STAT = ("id", "path", "size", "content_hash", "phash", "missing")
_KEEPER = ("size", "mtime", "width", "height")
_KIND = ("file_name", "camera_make", "camera_model", "lens", "iso", "date_taken", "width", "height")


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files on disk: those `file_meta` reports under their known path, with the size it reports, and new ones."""
    seen = table(spark, sf, "file_meta").groupBy("media_id").agg(F.max("size").alias("size"))
    known = _media(spark, sf, "id", "path", "mtime").join(seen.withColumnRenamed("media_id", "id"), "id").select("path", "size", "mtime")
    return known.unionByName(table(spark, sf, "incoming").select("path", "size", "mtime").distinct())


def _new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows an index run writes: the known files listed, and the incoming ones."""
    media = _media(spark, sf)
    known = media.drop("size").join(_listing(spark, sf).select("path", "size"), "path").withColumn("content_hash", F.lit(None).cast("string")).withColumn("phash", F.lit(None).cast("long"))
    new = table(spark, sf, "incoming").drop("batch_no", "id", "arrived_at").distinct()
    return known.drop("id", "missing", "meta_version").unionByName(new, allowMissingColumns=True)


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Entries for the non-keepers of exact groups: the batch is the year of the file, pictures with a camera were restored."""
    gone = d.with_keeper(d.exact_members(_present(spark, sf, columns=(*_KEEPER, "camera_model")))).where("not is_keeper").select("id", "path", "mtime", "camera_model")
    return gone.select(
        "id", F.year(F.timestamp_seconds("mtime")).cast("long").alias("batch"), F.col("path").alias("original_path"), F.concat(F.lit("/vault"), "path").alias("quarantine_path"), F.col("mtime").alias("moved_at"), F.col("camera_model").isNotNull().alias("restored")
    )


# --- SQL building blocks -------------------------------------------------------------------------

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CLASS = (
    f"CASE WHEN {' OR '.join(f'contains(lower(file_name), {h!r})' for h in m.SCREENSHOT_HINTS)} THEN 'screenshot' "
    "WHEN camera_make IS NOT NULL OR camera_model IS NOT NULL OR lens IS NOT NULL OR iso IS NOT NULL OR date_taken IS NOT NULL THEN 'photo' "
    f"WHEN (width, height) IN ({', '.join(f'({a}, {b}), ({b}, {a})' for a, b in m.SCREEN_SIZES)}) THEN 'screenshot' ELSE 'saved' END"
)
_CTE = f"""
md AS (SELECT DISTINCT * EXCLUDE (indexed_at) FROM media),
um AS (SELECT content_hash, bool_or(doc_kind = 'question') AS hidden, CAST(least(count(*), 5) AS TINYINT) AS rating, CASE WHEN bool_or(doc_kind = 'manual') THEN 'saved' END AS kind
       FROM documents JOIN md ON media_id = md.id WHERE content_hash IS NOT NULL GROUP BY content_hash),
al AS (SELECT md.*, coalesce(hidden, false) AS hidden, coalesce(rating, 0) AS rating, kind, coalesce(kind, {_CLASS}) AS eff FROM md LEFT JOIN um USING (content_hash) WHERE NOT missing),
vis AS (SELECT * FROM al WHERE NOT hidden)"""
_KEEP = "ORDER BY -coalesce(CAST(width AS BIGINT) * height, 0), -size, mtime, strlen(path), path"
_EXACT = f"""
ex AS (SELECT *, count(*) OVER w AS n, min(id) OVER w AS group_id, row_number() OVER (PARTITION BY content_hash {_KEEP}) AS r, arg_min(path, string_split(path, '/')) OVER w AS first_path
       FROM al WHERE content_hash IS NOT NULL WINDOW w AS (PARTITION BY content_hash)),
exg AS (SELECT 'exact' AS dup_kind, group_id, CAST(n AS BIGINT) AS n, max(CASE WHEN r = 1 THEN id END) AS keeper_id, CAST(sum(CASE WHEN r > 1 THEN size END) AS BIGINT) AS reclaimable, 0 AS spread, any_value(first_path) AS first_path FROM ex WHERE n > 1 GROUP BY group_id, n)"""
_NEARS = f"""
np AS (SELECT DISTINCT phash FROM al WHERE phash IS NOT NULL),
arc AS (SELECT a.phash AS a, b.phash AS b FROM np a JOIN np b ON a.phash <> b.phash AND bit_count(xor(a.phash, b.phash)) <= 6),
reach AS (SELECT phash AS a, phash AS b FROM np UNION SELECT r.a, arc.b FROM reach r JOIN arc ON r.b = arc.a),
root AS (SELECT a AS phash, min(b) AS root FROM reach GROUP BY a),
ne0 AS (SELECT al.*, root FROM al JOIN root USING (phash)),
ok AS (SELECT root FROM ne0 GROUP BY root HAVING count(*) > 1 AND NOT (count(content_hash) = count(*) AND min(content_hash) = max(content_hash))),
ne AS (SELECT *, count(*) OVER (PARTITION BY root) AS n, min(id) OVER (PARTITION BY root) AS group_id, row_number() OVER (PARTITION BY root {_KEEP}) AS r FROM ne0 WHERE root IN (SELECT root FROM ok)),
sp AS (SELECT a.root, max(bit_count(xor(a.phash, b.phash))) AS spread FROM (SELECT DISTINCT root, phash FROM ne) a JOIN (SELECT DISTINCT root, phash FROM ne) b USING (root) GROUP BY 1),
neg AS (SELECT 'near' AS dup_kind, group_id, CAST(n AS BIGINT) AS n, max(CASE WHEN r = 1 THEN id END) AS keeper_id, CAST(sum(CASE WHEN r > 1 THEN size END) AS BIGINT) AS reclaimable, CAST(any_value(spread) AS INT) AS spread,
        arg_min(path, string_split(path, '/')) AS first_path FROM ne JOIN sp USING (root) GROUP BY group_id, n)"""


def query(name: str, sql: str | None = None, ctes: str = _CTE, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{sql}"
        return f

    return add


_STATS = "CAST(count(*) AS BIGINT) AS files, CAST(count(content_hash) AS BIGINT) AS hashed, CAST(count(phash) AS BIGINT) AS phashed, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes"
_ROW = "id, path, size, hidden, CAST(rating AS INT) AS rating, kind"


def _row(df: DataFrame) -> DataFrame:
    return df.select("id", "path", "size", "hidden", F.col("rating").cast("int").alias("rating"), "kind")


@query("library_stats", f"SELECT {_STATS} FROM al")
def library_stats(spark, sf):
    return c.library_stats(_media(spark, sf, *_STAT))


@query("library_stats_under_root", f"SELECT {_STATS} FROM al WHERE starts_with(path, '{ROOT}/')")
def library_stats_under_root(spark, sf):
    return c.library_stats(_media(spark, sf, *_STAT), ROOT)


@query("library_stats_by_folder", f"SELECT string_split(path, '/')[3] AS folder, {_STATS} FROM al GROUP BY 1")
def library_stats_by_folder(spark, sf):
    return c.stats_by_folder(_media(spark, sf, *_STAT))


@query("size_collisions", "SELECT size, CAST(count(*) AS BIGINT) AS files FROM al GROUP BY size HAVING count(*) > 1")
def size_collisions(spark, sf):
    return c.colliding_sizes(_media(spark, sf, "id", "size", "missing"))


@query("hash_worklist", "SELECT id, path, size FROM al WHERE content_hash IS NULL AND size IN (SELECT size FROM al GROUP BY size HAVING count(*) > 1)")
def hash_worklist(spark, sf):
    return c.hash_worklist(_media(spark, sf, "id", "path", "size", "content_hash", "missing"))


@query("analysis_worklist", f"SELECT id, path FROM al WHERE (phash IS NULL OR dom_color IS NULL) AND lower(ext) IN ({_IN(m.DECODABLE_EXTS)})")
def analysis_worklist(spark, sf):
    return c.analysis_worklist(_media(spark, sf, "id", "path", "ext", "phash", "dom_color", "missing"))


@query("present_all", f"SELECT {_ROW} FROM al")
def present_all(spark, sf):
    return _row(_present(spark, sf, columns=("size",)))


@query("present_visible", f"SELECT {_ROW} FROM vis")
def present_visible(spark, sf):
    return _row(_present(spark, sf, c.VISIBLE_ONLY, ("size",)))


@query("present_under_root", f"SELECT {_ROW} FROM vis WHERE starts_with(path, '{ROOT}/')")
def present_under_root(spark, sf):
    return _row(c.present(_media(spark, sf, "id", "path", "size", "content_hash", "missing"), _user_meta(spark, sf), c.VISIBLE_ONLY, ROOT))


@query("hidden_count", "SELECT CAST(count(*) AS BIGINT) AS hidden FROM al WHERE hidden")
def hidden_count(spark, sf):
    return c.hidden_count(_media(spark, sf, "id", "content_hash", "missing"), _user_meta(spark, sf))


@query("stamps", "SELECT id, path, size, mtime, meta_version, missing, content_hash IS NOT NULL AS has_hash, phash IS NOT NULL AS has_phash FROM md")
def stamps(spark, sf):
    return c.stamps(_media(spark, sf, "id", "path", "size", "mtime", "meta_version", "missing", "content_hash", "phash"))


@query("user_meta", "SELECT content_hash, hidden, CAST(rating AS INT) AS rating, kind FROM um")
def user_meta(spark, sf):
    return _user_meta(spark, sf).select("content_hash", "hidden", F.col("rating").cast("int").alias("rating"), "kind")


@query("kind_effective", "SELECT id, eff AS kind, eff || CASE WHEN kind IS NULL THEN '' ELSE '*' END AS label FROM al")
def kind_effective(spark, sf):
    return _present(spark, sf, columns=_KIND).select("id", m.effective_kind().alias("kind"), m.kind_label().alias("label"))


@query("kind_counts", "SELECT eff AS kind, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM al GROUP BY eff")
def kind_counts(spark, sf):
    return _present(spark, sf, columns=(*_KIND, "size")).groupBy(m.effective_kind().alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("exact_members", "SELECT id, group_id, r = 1 AS is_keeper FROM ex WHERE n > 1", _CTE + "," + _EXACT)
def exact_members(spark, sf):
    x = d.with_keeper(d.exact_members(_present(spark, sf, columns=_KEEPER)))
    names = x.groupBy("group_key").agg(F.min("id").alias("group_id"))
    return x.join(names, "group_key").select("id", "group_id", "is_keeper")


_GROUP = "dup_kind, group_id, n, keeper_id, reclaimable, spread, first_path"


@query("exact_groups", f"SELECT {_GROUP} FROM exg", _CTE + "," + _EXACT)
def exact_groups(spark, sf):
    return d.groups(d.exact_members(_present(spark, sf, columns=(*_KEEPER, "phash")))).select(*_GROUP.split(", "))


@query(
    "exact_groups_by_kind",
    "SELECT eff AS scope, min(id) AS group_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM al WHERE content_hash IS NOT NULL GROUP BY eff, content_hash HAVING count(*) > 1",
)
def exact_groups_by_kind(spark, sf):
    return d.groups(d.exact_members(_present(spark, sf), by_kind=True)).select("scope", "group_id", "n", "bytes")


@query("near_pairs_t6", "SELECT a.phash AS a, b.phash AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM np a JOIN np b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 6", _CTE + ", np AS (SELECT DISTINCT phash FROM al WHERE phash IS NOT NULL)")
def near_pairs_t6(spark, sf):
    return hamming_pairs(_present(spark, sf, columns=("phash",)), 6)


@query("near_pairs_t12", "SELECT a.phash AS a, b.phash AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INT) AS distance FROM np a JOIN np b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 12", _CTE + ", np AS (SELECT DISTINCT phash FROM al WHERE phash IS NOT NULL)")
def near_pairs_t12(spark, sf):
    return hamming_pairs(_present(spark, sf, columns=("phash",)), 12)


@query("near_members", "SELECT id, group_id, r = 1 AS is_keeper FROM ne", _CTE + "," + _NEARS, recursive=True)
def near_members(spark, sf):
    x = d.with_keeper(d.near_members(_present(spark, sf, columns=(*_KEEPER, "phash"))))
    names = x.groupBy("group_key").agg(F.min("id").alias("group_id"))
    return x.join(names, "group_key").select("id", "group_id", "is_keeper")


@query("near_groups", f"SELECT {_GROUP} FROM neg", _CTE + "," + _NEARS, recursive=True)
def near_groups(spark, sf):
    return d.groups(d.near_members(_present(spark, sf, columns=(*_KEEPER, "phash")))).select(*_GROUP.split(", "))


def _burst_sql(window: int) -> str:
    return f""",
b0 AS (SELECT *, coalesce(camera_model, '') AS cam, CASE WHEN date_taken - lag(date_taken) OVER w <= {window} THEN 0 ELSE 1 END AS fresh FROM al WHERE date_taken IS NOT NULL WINDOW w AS (PARTITION BY coalesce(camera_model, '') ORDER BY date_taken, path)),
b1 AS (SELECT *, sum(fresh) OVER (PARTITION BY cam ORDER BY date_taken, path) AS run FROM b0),
bg AS (SELECT min(id) AS group_id, cam, min(date_taken) AS start_s, max(date_taken) AS end_s, CAST(count(*) AS BIGINT) AS n FROM b1 GROUP BY cam, run HAVING count(*) > 1 AND NOT (count(content_hash) = count(*) AND min(content_hash) = max(content_hash)))"""


def _bursts(spark, sf, window):
    x = d.burst_members(_present(spark, sf, columns=("camera_model", "date_taken")), window)
    return x.groupBy("group_key").agg(F.min("id").alias("group_id"), F.coalesce(F.max("camera_model"), F.lit("")).alias("cam"), F.min("date_taken").alias("start_s"), F.max("date_taken").alias("end_s"), F.count(F.lit(1)).alias("n")).drop("group_key")


@query("burst_runs_2s", "SELECT * FROM bg", _CTE + _burst_sql(2))
def burst_runs_2s(spark, sf):
    return _bursts(spark, sf, 2)


@query("burst_runs_600s", "SELECT * FROM bg", _CTE + _burst_sql(600))
def burst_runs_600s(spark, sf):
    return _bursts(spark, sf, 600)


@query("dup_report", f"SELECT {_GROUP}, CAST(row_number() OVER (ORDER BY dup_kind, reclaimable DESC, string_split(first_path, '/'), group_id) AS BIGINT) AS rank FROM (FROM exg UNION ALL FROM neg)", _CTE + "," + _EXACT + "," + _NEARS, recursive=True)
def dup_report(spark, sf):
    return d.report(d.all_members(_present(spark, sf, columns=(*_KEEPER, "phash")), by_kind=False)).select(*_GROUP.split(", "), "rank")


@query("dup_totals", "SELECT dup_kind, CAST(count(*) AS BIGINT) AS groups, CAST(sum(reclaimable) AS BIGINT) AS reclaimable, CAST(sum(n - 1) AS BIGINT) AS removable FROM (FROM exg UNION ALL FROM neg) GROUP BY 1", _CTE + "," + _EXACT + "," + _NEARS, recursive=True)
def dup_totals(spark, sf):
    return d.totals(d.groups(d.all_members(_present(spark, sf, columns=(*_KEEPER, "phash")), by_kind=False)))


@query("removal_selection", "SELECT id, path, size FROM ex WHERE n > 1 AND r > 1", _CTE + "," + _EXACT)
def removal_selection(spark, sf):
    return d.removal_selection(d.exact_members(_present(spark, sf, columns=_KEEPER)))


@query("removal_plan", "SELECT path, '/vault/batch-0007' || path AS dest FROM ex WHERE n > 1 AND r > 1", _CTE + "," + _EXACT)
def removal_plan(spark, sf):
    return rename.removal_plan(removal_selection(spark, sf), "/vault", 7, _media(spark, sf, "id", "path"))


@query("images_text_filter", "SELECT id FROM vis WHERE contains(lower(path), 'summer')")
def images_text_filter(spark, sf):
    return o.visible_images(_present(spark, sf, c.VISIBLE_ONLY), text=" Summer ").select("id")


@query("images_min_rating", "SELECT id, CAST(rating AS INT) AS rating FROM vis WHERE rating >= 2")
def images_min_rating(spark, sf):
    return o.visible_images(_present(spark, sf, c.VISIBLE_ONLY), min_rating=2).select("id", F.col("rating").cast("int").alias("rating"))


@query("images_kind_filter", "SELECT id FROM vis WHERE eff IN ('screenshot', 'saved')")
def images_kind_filter(spark, sf):
    return o.visible_images(_present(spark, sf, c.VISIBLE_ONLY), kinds=["screenshot", "saved"]).select("id")


def _ranked(spark, sf, order: str, columns: tuple[str, ...]) -> DataFrame:
    """Visible rows ranked; only what the order needs is carried through it."""
    return o.ranked(_present(spark, sf, c.VISIBLE_ONLY, columns).select("id", *dict.fromkeys(("path", *columns)), "rating"), order)


_PATHS = "string_split(path, '/')"
_HSL = """,
ch AS (SELECT id, path, dom_color, CAST((dom_color >> 16) & 255 AS FLOAT) / 255::FLOAT AS r, CAST((dom_color >> 8) & 255 AS FLOAT) / 255::FLOAT AS g, CAST(dom_color & 255 AS FLOAT) / 255::FLOAT AS b FROM vis),
mx AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, greatest(r, g, b) - least(r, g, b) AS dl, (greatest(r, g, b) + least(r, g, b)) / 2::FLOAT AS l FROM ch),
sx AS (SELECT *, CASE WHEN dl <= 1.1920929e-07::FLOAT THEN 0::FLOAT WHEN l > 0.5::FLOAT THEN dl / (2::FLOAT - hi - lo) ELSE dl / (hi + lo) END AS s,
       CASE WHEN dl <= 1.1920929e-07::FLOAT THEN 0::FLOAT WHEN hi = r THEN (g - b) / dl * 60::FLOAT WHEN hi = g THEN ((b - r) / dl + 2::FLOAT) * 60::FLOAT ELSE ((r - g) / dl + 4::FLOAT) * 60::FLOAT END AS h0 FROM mx),
hs AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360::FLOAT ELSE h0 END AS h FROM sx),
hk AS (SELECT *, CAST(CASE WHEN dom_color IS NULL THEN 2 WHEN s < 0.15::FLOAT THEN 1 ELSE 0 END AS INT) AS bucket,
       CAST(CASE WHEN dom_color IS NULL THEN 0 WHEN s < 0.15::FLOAT THEN trunc(l * 1000::FLOAT) ELSE trunc(h * 10::FLOAT) END AS INT) AS major,
       CAST(CASE WHEN dom_color IS NULL OR s < 0.15::FLOAT THEN 0 ELSE trunc(l * 1000::FLOAT) END AS INT) AS minor FROM hs)"""


@query("rank_path", f"SELECT id, CAST(row_number() OVER (ORDER BY {_PATHS}) AS BIGINT) AS rank FROM vis")
def rank_path(spark, sf):
    return _ranked(spark, sf, "path", ("path",)).select("id", "rank")


@query("rank_date", f"SELECT id, CAST(row_number() OVER (ORDER BY coalesce(date_taken, mtime), {_PATHS}) AS BIGINT) AS rank FROM vis")
def rank_date(spark, sf):
    return _ranked(spark, sf, "date", ("date_taken", "mtime")).select("id", "rank")


@query("rank_size", f"SELECT id, CAST(row_number() OVER (ORDER BY size DESC, {_PATHS}) AS BIGINT) AS rank FROM vis")
def rank_size(spark, sf):
    return _ranked(spark, sf, "size", ("size",)).select("id", "rank")


@query("rank_colour", f"SELECT id, bucket, major, minor, CAST(row_number() OVER (ORDER BY bucket, major, minor, {_PATHS}) AS BIGINT) AS rank FROM hk", _CTE + _HSL)
def rank_colour(spark, sf):
    k = m.hue_key()
    return _ranked(spark, sf, "colour", ("dom_color",)).select("id", k["bucket"].alias("bucket"), k["major"].alias("major"), k["minor"].alias("minor"), "rank")


@query("rank_rating", f"SELECT id, CAST(row_number() OVER (ORDER BY rating DESC, {_PATHS}) AS BIGINT) AS rank FROM vis")
def rank_rating(spark, sf):
    return _ranked(spark, sf, "rating", ("path",)).select("id", "rank")


@query("hsl", "SELECT id, CAST(h AS DOUBLE) AS h, CAST(s AS DOUBLE) AS s, CAST(l AS DOUBLE) AS l FROM hs WHERE dom_color IS NOT NULL", _CTE + _HSL)
def hsl(spark, sf):
    x = m.hsl()
    return _present(spark, sf, c.VISIBLE_ONLY, ("dom_color",)).where("dom_color is not null").select("id", *[x[k].cast("double").alias(k) for k in "hsl"])


# The exchanges of the shuffle one by one, then where each place's item came from: an item that stands at a place before exchange k
# was put there by the latest earlier exchange that had this place as its partner.
_SHUFFLE = f""",
c AS (SELECT CAST(count(*) AS BIGINT) AS n FROM vis),
g AS (SELECT 0::BIGINT AS k, 42::HUGEINT AS x UNION ALL SELECT k + 1, xor(b, (b * 131072) % 18446744073709551616) FROM (SELECT k, xor(a, a // 128) AS b FROM (SELECT k, xor(x, (x * 8192) % 18446744073709551616) AS a FROM g WHERE k < (SELECT n - 1 FROM c)))),
sw AS (SELECT k, CAST(x % (n - k + 1) AS BIGINT) AS other FROM g, c WHERE k BETWEEN 1 AND n - 1),
st AS (SELECT n - a.k AS p, a.other AS q, max(b.k) AS j FROM sw a CROSS JOIN c LEFT JOIN sw b ON b.other = a.other AND b.k < a.k GROUP BY ALL UNION ALL SELECT 0, 0, max(k) FROM sw WHERE other = 0),
nx AS (SELECT a.k AS j, max(b.k) AS i FROM sw a CROSS JOIN c JOIN sw b ON b.other = n - a.k AND b.k < a.k GROUP BY 1),
r AS (SELECT p, j FROM st WHERE j IS NOT NULL UNION ALL SELECT r.p, nx.i FROM r JOIN nx ON nx.j = r.j),
fin AS (SELECT st.p, coalesce(n - min(r.j), any_value(q)) AS v FROM st CROSS JOIN c LEFT JOIN r USING (p) GROUP BY st.p, n),
od AS (SELECT id, row_number() OVER (ORDER BY {_PATHS}) - 1 AS v FROM vis)"""


@query("shuffle_seeded", "SELECT id, CAST(p + 1 AS BIGINT) AS rank FROM fin JOIN od USING (v)", _CTE + _SHUFFLE, recursive=True)
def shuffle_seeded(spark, sf):
    return o.shuffled(_present(spark, sf, c.VISIBLE_ONLY, ("path",)).select("id", "path"), 42).select("id", "rank")


@query(
    "human_bytes",
    "SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN format('{:.1f} KB', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN format('{:.1f} MB', size / 1048576.0::DOUBLE) ELSE format('{:.1f} GB', size / 1073741824.0::DOUBLE) END AS text FROM al",
)
def human_bytes(spark, sf):
    return _present(spark, sf).select("id", m.human_bytes("size").alias("text"))


@query(
    "format_coords",
    "SELECT id, format('{:.5f}°{}, {:.5f}°{}', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lon), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS text FROM al WHERE lat IS NOT NULL AND lon IS NOT NULL",
)
def format_coords(spark, sf):
    return _present(spark, sf).where("lat is not null and lon is not null").select("id", m.coords_text().alias("text"))


@query("star_captions", "SELECT id, repeat('★', CAST(rating AS INT)) || repeat('☆', 5 - CAST(rating AS INT)) AS caption FROM al")
def star_captions(spark, sf):
    return _present(spark, sf).select("id", m.stars().alias("caption"))


@query(
    "path_parts",
    r"SELECT id, regexp_replace(f, '(.)\.[^.]*$', '\1', 's') AS stem, regexp_extract(f, '^.+\.([^.]*)$', 1, 's') AS ext, p[-2] AS parent FROM (SELECT id, string_split(path, '/') AS p, string_split(path, '/')[-1] AS f FROM al)",
)
def path_parts(spark, sf):
    return _present(spark, sf).select("id", m.stem().alias("stem"), m.extension().alias("ext"), m.parent_name().alias("parent"))


@query("sanitized_names", r"""SELECT id, regexp_replace(path, '[/\\:*?"<>|]', '_', 'g') AS name FROM al""")
def sanitized_names(spark, sf):
    return _present(spark, sf).select("id", m.sanitized("path").alias("name"))


@query("content_digests", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", m.content_digest(F.col("text").cast("binary")).alias("digest"))


@query("thumbnail_paths", "SELECT id, k[1:2] || '/' || k || '.jpg' AS place FROM (SELECT id, sha256(path || chr(31) || size || chr(31) || mtime || chr(31))[1:32] AS k FROM al)")
def thumbnail_paths(spark, sf):
    return _present(spark, sf).select("id", m.thumbnail_path().alias("place"))


_LIST = """,
li AS (SELECT path, max(f.size) AS size, any_value(md.mtime) AS mtime FROM md JOIN file_meta f ON f.media_id = md.id GROUP BY path UNION ALL SELECT DISTINCT path, size, mtime FROM incoming),
ch AS (SELECT coalesce(li.path, md.path) AS path, id, CASE WHEN id IS NULL THEN 'new' WHEN li.path IS NULL AND missing THEN 'gone' WHEN li.path IS NULL THEN 'vanished'
       WHEN li.size IS DISTINCT FROM md.size OR li.mtime IS DISTINCT FROM md.mtime THEN 'changed' WHEN meta_version <> 2 OR missing THEN 'stale' ELSE 'unchanged' END AS change FROM li FULL JOIN md ON li.path = md.path)"""


@query("change_classify", "SELECT * FROM ch", _CTE + _LIST)
def change_classify(spark, sf):
    return c.classify_changes(_listing(spark, sf), _media(spark, sf, "id", "path", "size", "mtime", "meta_version", "missing"))


@query(
    "index_outcome",
    "SELECT CAST(count(*) FILTER (change NOT IN ('gone', 'vanished')) AS BIGINT) AS scanned, CAST(count(*) FILTER (change IN ('new', 'changed', 'stale')) AS BIGINT) AS updated, CAST(count(*) FILTER (change = 'unchanged') AS BIGINT) AS unchanged, CAST(count(*) FILTER (change IN ('gone', 'vanished')) AS BIGINT) AS missing FROM ch",
    _CTE + _LIST,
)
def index_outcome(spark, sf):
    return c.index_outcome(change_classify(spark, sf))


@query(
    "upsert_merge",
    """, ix AS (SELECT DISTINCT path, file_name, ext, size, mtime, width, height, content_hash, phash, camera_model FROM incoming),
old AS (SELECT md.id, md.path, coalesce(li.size, md.size) AS size, CASE WHEN li.path IS NULL OR li.size = md.size THEN md.content_hash END AS content_hash, CASE WHEN li.path IS NULL OR li.size = md.size THEN md.phash END AS phash,
        CASE WHEN li.path IS NULL THEN missing ELSE false END AS missing, CASE WHEN li.path IS NULL THEN meta_version ELSE 2 END AS meta_version FROM md LEFT JOIN li ON li.path = md.path)
SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM md) + row_number() OVER (ORDER BY path), path, size, content_hash, phash, false, 2 FROM ix""",
    _CTE + _LIST,
)
def upsert_merge(spark, sf):
    return c.upsert(_media(spark, sf), _new_rows(spark, sf)).select("id", "path", "size", "content_hash", "phash", "missing", "meta_version")


@query("mark_missing", f"SELECT id, missing OR (starts_with(path, '{ROOT}/') AND id NOT IN (SELECT media_id FROM file_meta WHERE media_id IS NOT NULL)) AS missing FROM md")
def mark_missing(spark, sf):
    seen = table(spark, sf, "file_meta").select(F.col("media_id").alias("id")).where("id is not null")
    return c.mark_missing(_media(spark, sf, "id", "path", "missing"), seen, ROOT).select("id", "missing")


@query("purge_missing", "SELECT id FROM md WHERE NOT missing")
def purge_missing(spark, sf):
    return c.purge_missing(_media(spark, sf, "id", "missing")).select("id")


@query("remove_paths", "SELECT id FROM md WHERE id NOT IN (SELECT id FROM ex WHERE n > 1 AND r > 1)", _CTE + "," + _EXACT)
def remove_paths(spark, sf):
    return c.remove_paths(_media(spark, sf, "id", "path"), removal_selection(spark, sf)).select("id")


@query(
    "apply_moves",
    """SELECT id, CASE WHEN missing THEN path ELSE '/sorted/' || lower(ext) || '/' || id || '.' || ext END AS path, CASE WHEN missing THEN file_name ELSE id || '.' || ext END AS file_name, ext, missing FROM md""",
)
def apply_moves(spark, sf):
    media = _media(spark, sf, "id", "path", "file_name", "ext", "missing")
    moves = media.where("not missing").select(F.col("path").alias("src"), F.concat(F.lit("/sorted/"), F.lower("ext"), F.lit("/"), "id", F.lit("."), "ext").alias("dst"))
    return c.apply_moves(media, moves).select("id", "path", "file_name", "ext", "missing")


@query(
    "user_meta_upsert",
    "SELECT coalesce(um.content_hash, e.h) AS content_hash, coalesce(um.hidden, false) AS hidden, CASE WHEN e.h IS NOT NULL THEN 5 ELSE CAST(um.rating AS INT) END AS rating, kind FROM um FULL JOIN (SELECT DISTINCT lower(content_hash) AS h FROM incoming WHERE content_hash IS NOT NULL) e ON e.h = um.content_hash",
)
def user_meta_upsert(spark, sf):
    edits = table(spark, sf, "incoming").select(F.lower("content_hash").alias("content_hash"), F.lit(99).alias("rating")).where("content_hash is not null").distinct()
    out = c.set_user_meta(_user_meta(spark, sf), edits, F.lit(0))
    return out.select("content_hash", "hidden", F.col("rating").cast("int").alias("rating"), "kind")


_LEDGER = ", led AS (SELECT id, CAST(year(to_timestamp(mtime) AT TIME ZONE 'UTC') AS BIGINT) AS batch, path AS original_path, camera_model IS NOT NULL AS restored FROM ex WHERE n > 1 AND r > 1)"


@query("ledger_next_batch", "SELECT CAST(coalesce(max(batch), 0) + 1 AS BIGINT) AS next_batch, max(batch) FILTER (NOT restored) AS latest_restorable FROM led", _CTE + "," + _EXACT + _LEDGER.replace("to_timestamp(mtime) AT TIME ZONE 'UTC'", "make_timestamp(mtime * 1000000)"))
def ledger_next_batch(spark, sf):
    return c.next_batch(_ledger(spark, sf))


@query("ledger_pending", "SELECT id, batch, original_path, CAST(row_number() OVER (ORDER BY id DESC) AS BIGINT) AS rank FROM led WHERE NOT restored", _CTE + "," + _EXACT + _LEDGER.replace("to_timestamp(mtime) AT TIME ZONE 'UTC'", "make_timestamp(mtime * 1000000)"))
def ledger_pending(spark, sf):
    return o.global_rank(c.pending(_ledger(spark, sf)), [F.col("id").desc()]).select("id", "batch", "original_path", "rank")


def _files(spark, sf):
    p = _present(spark, sf)
    return p.select("path", m.stem().alias("name"), m.extension().alias("ext"), m.parent_name().alias("parent"), "size", "camera_model", F.timestamp_seconds("date_taken").alias("date_taken"), F.col("width").cast("string").alias("width"))


_PLAN = r""",
fs AS (SELECT path AS src, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1', 's') AS name, regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1, 's') AS ext, regexp_replace(camera_model, '[/\\:*?"<>|]', '_', 'g') AS cam,
       make_timestamp(date_taken * 1000000) AS dt, CAST(row_number() OVER (ORDER BY string_split(path, '/')) AS BIGINT) AS n FROM al),
"""
_RENAME = (
    _PLAN
    + r"""rt AS (SELECT *, CASE WHEN dt IS NULL THEN 'no value for {date_taken}' WHEN cam IS NULL THEN 'no value for {camera_model}' END AS detail, strftime(dt, '%Y') || '/' || cam || '/' || lpad(CAST(n AS VARCHAR), greatest(3, len(CAST(n AS VARCHAR)))::INT, '0') || '_' || name || '.' || ext AS t FROM fs),
pl AS (SELECT n, src, CASE WHEN detail IS NULL THEN t ELSE '' END AS rel_target, CASE WHEN detail IS NULL THEN 'ok' ELSE 'error' END AS status, detail FROM rt)"""
)


@query("rename_plan", "SELECT * FROM pl", _CTE + _RENAME)
def rename_plan(spark, sf):
    return rename.plan(_files(spark, sf), "{date_taken:%Y}/{camera_model}/{n:03}_{name}")


@query("plan_status_counts", "SELECT CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status <> 'ok') AS BIGINT) AS problems FROM pl", _CTE + _RENAME)
def plan_status_counts(spark, sf):
    return rename.counts(rename_plan(spark, sf))


@query(
    "rename_collisions",
    "SELECT src, rel_target, CASE WHEN detail IS NOT NULL THEN 'error' WHEN count(*) OVER (PARTITION BY detail IS NULL, rel_target) > 1 THEN 'collision' ELSE 'ok' END AS status FROM (SELECT src, CASE WHEN dt IS NULL THEN 'x' END AS detail, CASE WHEN dt IS NULL THEN '' ELSE strftime(dt, '%Y-%m-%d') || '.' || ext END AS rel_target FROM fs)",
    _CTE + _PLAN.rstrip().rstrip(","),
)
def rename_collisions(spark, sf):
    return rename.plan(_files(spark, sf), "{date_taken}").select("src", "rel_target", "status")


@query(
    "rename_exists",
    "SELECT src, '/lib/Camera/' || name || '.' || ext AS target, CASE WHEN count(*) OVER (PARTITION BY name, ext) > 1 THEN 'collision' WHEN '/lib/Camera/' || name || '.' || ext IN (SELECT path FROM md WHERE missing) THEN 'exists' ELSE 'ok' END AS status FROM fs",
    _CTE + _PLAN.rstrip().rstrip(","),
)
def rename_exists(spark, sf):
    p = rename.plan(_files(spark, sf), "{name}", output_root="/lib/Camera", existing=_media(spark, sf, "id", "path").select("path"))
    return p.select("src", F.concat(F.lit("/lib/Camera/"), "rel_target").alias("target"), "status")


@query(
    "meta_rows",
    "SELECT DISTINCT meta_id, name || '.' || ext AS file_name, size, camera_model, TRY_CAST(CASE WHEN regexp_full_match(trim(width), '[+-]?[0-9]+') THEN trim(width) END AS INT) AS width, TRY_CAST(CASE WHEN regexp_full_match(trim(height), '[+-]?[0-9]+') THEN trim(height) END AS INT) AS height FROM file_meta",
)
def meta_rows(spark, sf):
    """Extraction records as media rows: dimensions given as text become numbers or null."""
    raw = table(spark, sf, "file_meta").drop("date_taken", "mtime").distinct()
    rows = raw.withColumn("path", F.concat("name", F.lit("."), "ext")).withColumn("mtime", F.lit(0).cast("long"))
    keyed = rows.withColumn("iso", F.col("meta_id").cast("string"))
    return indexing.media_rows(keyed).select(F.col("iso").cast("long").alias("meta_id"), "file_name", "size", "camera_model", "width", "height")


@query("thumbnails_missing", "SELECT id, path FROM al WHERE lower(ext) IN (" + _IN(m.DECODABLE_EXTS) + ") AND missing = false AND meta_version <> 2")
def thumbnails_missing(spark, sf):
    """Pictures without thumbnail, where the cache holds those of rows of the present metadata version."""
    media = _media(spark, sf)
    cached = media.where("meta_version = 2").select(m.thumbnail_path().alias("place"))
    return indexing.thumbnails_missing(media, cached).select("id", "path")


@query("restore_plan", "SELECT id, original_path AS dst, original_path IN (SELECT path FROM md WHERE missing) AS blocked FROM led WHERE NOT restored AND batch = 2016", _CTE + "," + _EXACT + _LEDGER.replace("to_timestamp(mtime) AT TIME ZONE 'UTC'", "make_timestamp(mtime * 1000000)"))
def restore_plan(spark, sf):
    return indexing.restore_plan(_ledger(spark, sf), 2016, _media(spark, sf).where("missing").select("path")).select("id", "dst", "blocked")
