"""Further queries over the catalog: single-row writes, listings, labels, undo orders and reports by kind, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.operators import catalog as c
from fotolake.operators import dupes as d
from fotolake.operators import ordering as o
from fotolake.plans import indexing, library, rename
from fotolake.plans.library import _CTE, _EXACT, _GROUP, _KEEP, _LEDGER, _LIST, _RENAME, _ledger, _listing, _media, _present, _user_meta, rename_plan
from fotolake.runtime import table
from fotolake.schema import MEDIA, evolve
from fotolake.sources import exif, files, remote

QUERIES: dict[str, library.Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, ctes: str = _CTE, recursive: bool = False):
    def add(f: library.Query) -> library.Query:
        QUERIES[name] = f
        ORACLE[name] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{sql}"
        return f

    return add


_LED = _CTE + "," + _EXACT + _LEDGER.replace("to_timestamp(mtime) AT TIME ZONE 'UTC'", "make_timestamp(mtime * 1000000)")
_STEM = r"regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1', 's')"
_EXT = r"regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1, 's')"
_FOLDER = "array_to_string(string_split({0}, '/')[:-2], '/')"


# --- listings ------------------------------------------------------------------------------------


def _disk(spark, sf):
    """The catalog's files as a listing of a disk; a row of zero size stands for a file that could not be read."""
    error = F.when(F.col("size") == 0, "gone")
    return _media(spark, sf).select("path", "size", "mtime", (F.col("mtime") - 60).alias("created"), (F.col("mtime") + 60).alias("accessed"), error.alias("error"))


@query("listing_meta", f"SELECT path, {_STEM} AS name, {_EXT} AS ext, string_split(path, '/')[-2] AS parent, size, mtime - 60 AS created_s, mtime AS modified_s, mtime + 60 AS accessed_s FROM md WHERE size <> 0")
def listing_meta(spark, sf):
    """Names, folder and dates of listed files."""
    x = files.file_meta(_disk(spark, sf))
    return x.select("path", "name", "ext", "parent", "size", *[F.unix_seconds(f"date_{k}").alias(f"{k}_s") for k in ("created", "modified", "accessed")])


@query("folder_bytes", "SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM md")
def folder_bytes(spark, sf):
    return files.folder_bytes(_disk(spark, sf))


@query(
    "remote_listing",
    f"SELECT id AS fileid, path, {_STEM} AS name, {_EXT} AS ext, string_split(path, '/')[-2] AS parent, size, mtime AS created_s, CAST(width AS VARCHAR) AS width, CAST(height AS VARCHAR) AS height FROM md WHERE id >= 0",
)
def remote_listing(spark, sf):
    """Nested folder documents, one per file, flattened to files with absolute paths."""
    leaf = F.to_json(F.struct(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("id").alias("fileid"), "size", F.col("mtime").alias("created"), "width", "height"))
    folders = "reverse(slice(split(path, '/'), 2, size(split(path, '/')) - 2))"
    nest = "(inner, name) -> concat('{\"isfolder\":true,\"name\":', substring(to_json(struct(name as n)), 6, length(to_json(struct(name as n))) - 6), ',\"contents\":[', inner, ']}')"
    doc = _media(spark, sf).withColumn("_leaf", leaf).select(F.concat(F.lit('{"contents":['), F.expr(f"aggregate({folders}, _leaf, {nest})"), F.lit("]}")).alias("json"))
    x = remote.remote_files(doc)
    return x.select("fileid", "path", "name", "ext", "parent", "size", F.unix_seconds("date_created").alias("created_s"), "width", "height")


@query(
    "exif_times",
    "SELECT DISTINCT meta_id, CAST(epoch(try_strptime(CASE WHEN regexp_full_match(trim(date_taken), '[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') THEN trim(date_taken) END, '%Y:%m:%d %H:%M:%S')) AS BIGINT) AS taken_s FROM file_meta",
)
def exif_times(spark, sf):
    """Shutter times as the tag writes them; any other text is null."""
    return table(spark, sf, "file_meta").select("meta_id", F.unix_seconds(exif.exif_time("date_taken")).alias("taken_s")).distinct()


_DMS = "floor(abs({0})) AS {1}d, floor((abs({0}) - floor(abs({0}))) * 60) AS {1}m, ((abs({0}) - floor(abs({0}))) * 60 - floor((abs({0}) - floor(abs({0}))) * 60)) * 60 AS {1}s"


@query(
    "gps_decimal",
    f""", g AS (SELECT id, lat, lon, {_DMS.format("lat", "a")}, {_DMS.format("lon", "o")} FROM md WHERE lat IS NOT NULL AND lon IS NOT NULL),
x AS (SELECT id, CASE WHEN lat < 0 THEN -(ad + am / 60.0::DOUBLE + "as" / 3600.0::DOUBLE) ELSE ad + am / 60.0::DOUBLE + "as" / 3600.0::DOUBLE END AS a, CASE WHEN lon < 0 THEN -(od + om / 60.0::DOUBLE + os / 3600.0::DOUBLE) ELSE od + om / 60.0::DOUBLE + os / 3600.0::DOUBLE END AS o FROM g)
SELECT id, a AS lat, o AS lon FROM x WHERE abs(a) <= 90 AND abs(o) <= 180 AND NOT (a = 0 AND o = 0)""",
)
def gps_decimal(spark, sf):
    """Degrees, minutes and seconds with a hemisphere back to decimal degrees; implausible places are left out."""
    rows = _media(spark, sf).where("lat is not null and lon is not null")
    axis = lambda k, low, high: m.degrees_of(*_dms(F.abs(F.col(k))), F.when(F.col(k) < 0, low).otherwise(high))
    x = rows.select("id", axis("lat", "S", "N").alias("lat"), axis("lon", "w ", "E").alias("lon"))
    return x.where(m.plausible_place(F.col("lat"), F.col("lon")))


def _dms(x):
    whole = F.floor(x).cast("double")
    minutes = F.floor((x - whole) * 60).cast("double")
    return whole, minutes, ((x - whole) * 60 - minutes) * 60


# --- writes --------------------------------------------------------------------------------------


@query("set_hashes", "SELECT id, coalesce(content_hash, CASE WHEN NOT missing THEN sha256(path) END) AS content_hash FROM md")
def set_hashes(spark, sf):
    """Digests written to the rows that lack one."""
    media = _media(spark, sf)
    found = media.where("content_hash is null and not missing").select("id", F.sha2("path", 256).alias("content_hash"))
    return c.set_columns(media, found, ("content_hash",)).select("id", "content_hash")


@query("set_analysis", "SELECT id, CASE WHEN phash IS NULL THEN id ELSE phash END AS phash, CASE WHEN phash IS NOT NULL THEN dom_color END AS dom_color FROM md")
def set_analysis(spark, sf):
    """Analysis written to the rows without hash; a colour that could not be told is null."""
    media = _media(spark, sf)
    done = media.where("phash is null").select("id", F.col("id").alias("phash"), F.lit(None).cast("int").alias("dom_color"))
    return c.set_columns(media, done, ("phash", "dom_color")).select("id", "phash", "dom_color")


_SIZES = "SELECT media_id AS id, max(TRY_CAST(CASE WHEN regexp_full_match(trim(width), '[+-]?[0-9]+') THEN trim(width) END AS INT)) AS w, max(TRY_CAST(CASE WHEN regexp_full_match(trim(height), '[+-]?[0-9]+') THEN trim(height) END AS INT)) AS h FROM file_meta WHERE media_id IS NOT NULL GROUP BY 1"


@query("set_dimensions", f"SELECT md.id, coalesce(w, width) AS width, coalesce(h, height) AS height FROM md LEFT JOIN ({_SIZES}) s ON s.id = md.id")
def set_dimensions(spark, sf):
    """Measured dimensions written over known ones; what was not measured stays."""
    whole = lambda k: F.max(F.expr(f"try_cast(trim({k}) as int)")).alias(k)
    sizes = table(spark, sf, "file_meta").where("media_id is not null").groupBy(F.col("media_id").alias("id")).agg(whole("width"), whole("height"))
    return c.set_columns(_media(spark, sf), sizes, ("width", "height"), keep_known=True).select("id", "width", "height")


@query("ledger_record", "SELECT id, batch, original_path, restored FROM led UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM led) + row_number() OVER (ORDER BY path), 9999, path, false FROM md WHERE missing", _LED)
def ledger_record(spark, sf):
    """The ledger after the missing files were entered as one batch, numbered on by path."""
    entries = _media(spark, sf).where("missing").select(F.lit(9999).cast("long").alias("batch"), F.col("path").alias("original_path"), F.concat(F.lit("/vault"), "path").alias("quarantine_path"), F.col("mtime").alias("moved_at"))
    return c.record(_ledger(spark, sf), entries).select("id", "batch", "original_path", "restored")


@query("ledger_restored", "SELECT id, restored OR batch = 2016 AS restored FROM led", _LED)
def ledger_restored(spark, sf):
    """The ledger after everything pending of one batch was restored."""
    led = _ledger(spark, sf)
    return c.mark_restored(led, c.pending(led, 2016)).select("id", "restored")


@query("evolved_media", "SELECT id, path, size, NULL::INT AS dom_color, NULL::DOUBLE AS lat, false AS missing, 0::BIGINT AS meta_version FROM md")
def evolved_media(spark, sf):
    """Rows of a table from before colours, places, flags and metadata versions, read as of today."""
    old = _media(spark, sf).drop("dom_color", "lat", "lon", "missing", "meta_version")
    return evolve(old, MEDIA).select("id", "path", "size", "dom_color", "lat", "missing", "meta_version")


@query("index_counters", f"""SELECT CAST(count(*) FILTER (change NOT IN ('gone', 'vanished')) AS BIGINT) AS scanned, CAST(count(*) FILTER (change IN ('new', 'changed', 'stale')) AS BIGINT) AS updated, CAST(count(*) FILTER (change = 'unchanged') AS BIGINT) AS unchanged, CAST(count(*) FILTER (change IN ('gone', 'vanished')) AS BIGINT) AS missing,
 (SELECT count(*) FROM al WHERE content_hash IS NULL AND size IN (SELECT size FROM al GROUP BY size HAVING count(*) > 1)) AS hashed,
 (SELECT count(*) FROM al WHERE (phash IS NULL OR dom_color IS NULL) AND lower(ext) IN ({library._IN(m.DECODABLE_EXTS)})) AS analysed,
 (SELECT count(*) FROM al WHERE lower(ext) IN ({library._IN(m.DECODABLE_EXTS)}) AND meta_version <> 2) AS thumbnails, (SELECT count(*) FROM md WHERE size = 0) AS errors FROM ch""", _CTE + _LIST)  # fmt: skip
def index_counters(spark, sf):
    """All counters of an index run: what changed, and what was due for hashing, analysis and thumbnails."""
    media = _media(spark, sf)
    cached = media.where("meta_version = 2").select(m.thumbnail_path().alias("place"))
    due = {"hashed": c.hash_worklist(media), "analysed": c.analysis_worklist(media), "thumbnails": indexing.thumbnails_missing(media, cached), "errors": _disk(spark, sf).where("error is not null")}
    return c.index_outcome(c.classify_changes(_listing(spark, sf), media), **due)


@query("tag_worklist", "SELECT id, path FROM md WHERE content_hash IS NULL AND NOT missing AND id IN (SELECT media_id FROM documents)")
def tag_worklist(spark, sf):
    """Files that must be hashed before the tags documents give them can be kept."""
    return c.tag_worklist(_media(spark, sf), table(spark, sf, "documents").select(F.col("media_id").alias("id")))


# --- plans ---------------------------------------------------------------------------------------

# the flat targets of the removed files, with numbers for those taken: names in force are those of the catalog itself, flattened
_FLAT = f""",
gone AS (SELECT path, '/flat/' || (CASE WHEN id % 2 = 0 THEN string_split(path, '/')[3] || '.' || ext ELSE string_split(path, '/')[3] || '-' || (id % 40) || '.' || ext END) AS target FROM ex WHERE n > 1 AND r > 1),
there AS (SELECT DISTINCT '/flat/' || string_split(path, '/')[3] || '-' || (id % 9) || '.' || ext AS name FROM md),
frst AS (SELECT target, min(path) AS path FROM gone WHERE target NOT IN (SELECT name FROM there) GROUP BY target),
wait AS (SELECT g.target, g.path, row_number() OVER (PARTITION BY g.target ORDER BY g.path) AS i FROM gone g WHERE (g.target, g.path) NOT IN (SELECT (target, path) FROM frst)),
most AS (SELECT target, max(i) AS k FROM wait GROUP BY target),
num AS (SELECT target, unnest(range(2, CAST(k + 3000 AS BIGINT))) AS v FROM most),
name AS (SELECT target, v, regexp_replace(target, '\\.([^.]*)$', '-' || v || '.\\1') AS dest FROM num),
free AS (SELECT target, dest, row_number() OVER (PARTITION BY target ORDER BY v) AS i FROM name WHERE dest NOT IN (SELECT name FROM there) AND dest NOT IN (SELECT target FROM gone))"""


@query("removal_targets", "SELECT path, target AS dest FROM frst UNION ALL SELECT w.path, f.dest FROM wait w JOIN free f USING (target, i)", _CTE + "," + _EXACT + _FLAT)
def removal_targets(spark, sf):
    """Removed files sent to one flat folder: families of names, numbers in use, no name given twice."""
    folder = F.element_at(F.split("path", "/"), 3)
    x = d.with_keeper(d.exact_members(_present(spark, sf))).where("not is_keeper")
    plain = F.concat(F.lit("/flat/"), folder, F.lit("."), "ext")
    numbered = lambda k: F.concat(F.lit("/flat/"), folder, F.lit("-"), (F.col("id") % k).cast("string"), F.lit("."), "ext")
    rows = x.select("path", F.when(F.col("id") % 2 == 0, plain).otherwise(numbered(40)).alias("target"))
    there = _media(spark, sf).select(numbered(9).alias("path")).distinct()
    return c.unique_targets(rows, "target", there).select("path", "dest")


@query("plan_display", "SELECT string_split(src, '/')[-1] AS name, rel_target, status FROM pl", _CTE + _RENAME)
def plan_display(spark, sf):
    return rename.display(rename_plan(spark, sf))


@query("plan_labels", "SELECT src, rel_target, CASE WHEN status = 'error' THEN 'error: ' || detail ELSE status END AS label FROM pl", _CTE + _RENAME)
def plan_labels(spark, sf):
    return rename.labelled(rename_plan(spark, sf))


_MOVES = ", mv AS (SELECT n AS seq, src, '/sorted/' || rel_target AS dst FROM pl WHERE status = 'ok')"


def _moves(spark, sf):
    p = rename_plan(spark, sf)
    return p.where("status = 'ok'").select(F.col("n").alias("seq"), "src", F.concat(F.lit("/sorted/"), "rel_target").alias("dst"))


@query("rename_moves", "SELECT src, dst FROM mv", _CTE + _RENAME + _MOVES)
def rename_moves(spark, sf):
    return rename.moves(rename_plan(spark, sf), "/sorted")


@query("undo_order", "SELECT CAST(row_number() OVER (ORDER BY seq DESC) AS BIGINT) AS step, dst AS src, src AS dst FROM mv", _CTE + _RENAME + _MOVES)
def undo_order(spark, sf):
    return rename.undo_order(_moves(spark, sf))


@query("emptied_folders", f"SELECT CAST(row_number() OVER (ORDER BY len(string_split(folder, '/')) DESC, folder) AS BIGINT) AS step, folder FROM (SELECT DISTINCT {_FOLDER.format('dst')} AS folder FROM mv)", _CTE + _RENAME + _MOVES)
def emptied_folders(spark, sf):
    return rename.emptied_folders(_moves(spark, sf))


# --- small functions -----------------------------------------------------------------------------


@query("coords", "SELECT id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END AS lon FROM md")
def coords(spark, sf):
    """Both coordinates or neither."""
    return _media(spark, sf).select("id", m.coords().alias("_c")).select("id", "_c.lat", "_c.lon")


@query("rgb_channels", "SELECT id, CAST((dom_color >> 16) & 255 AS INT) AS r, CAST((dom_color >> 8) & 255 AS INT) AS g, CAST(dom_color & 255 AS INT) AS b, dom_color AS packed FROM md")
def rgb_channels(spark, sf):
    """Colours taken apart and packed again."""
    r, g, b = m.channels("dom_color")
    return _media(spark, sf).select("id", r.alias("r"), g.alias("g"), b.alias("b"), m.packed_rgb(r, g, b).alias("packed"))


@query("normalized_dirs", f"SELECT id, {_FOLDER.format('path')} AS dir FROM md")
def normalized_dirs(spark, sf):
    """Folders typed with blanks and extra slashes, in one form."""
    folder = F.expr("left(path, char_length(path) - char_length(substring_index(path, '/', -1)) - 1)")
    return _media(spark, sf).select("id", m.normalized_dir(F.concat(F.lit("  /"), folder, F.lit("// "))).alias("dir"))


@query("star_toggled", "SELECT id, CAST(CASE WHEN rating = 2 THEN 0 ELSE 2 END AS INT) AS rating FROM al")
def star_toggled(spark, sf):
    return _present(spark, sf).select("id", m.toggled_star("rating", 2).cast("int").alias("rating"))


@query("content_lookup", "SELECT CAST(coalesce(max(rating), 0) AS INT) AS rating, coalesce(bool_or(hidden), false) AS hidden FROM um WHERE content_hash = (SELECT min(content_hash) FROM md)")
def content_lookup(spark, sf):
    """Rating and flag of one content."""
    first = _media(spark, sf).agg(F.min("content_hash")).first()[0]
    x = c.point_lookup(_user_meta(spark, sf), first)
    return x.select(F.col("rating").cast("int").alias("rating"), "hidden")


@query("rank_path_bytes", "SELECT id, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS rank FROM md")
def rank_path_bytes(spark, sf):
    """The order of the catalog's own listing: bytes, not components."""
    return o.global_rank(_media(spark, sf).select("id", "path"), ["path"]).select("id", "rank")


@query("member_order", "SELECT group_id, id, CAST(row_number() OVER (PARTITION BY content_hash ORDER BY string_split(path, '/')) AS BIGINT) AS place FROM ex WHERE n > 1", _CTE + "," + _EXACT)
def member_order(spark, sf):
    x = d.exact_members(_present(spark, sf))
    names = x.groupBy("group_key").agg(F.min("id").alias("group_id"))
    return d.member_order(x).join(names, "group_key").select("group_id", "id", "place")


# --- duplicate reports by kind -------------------------------------------------------------------

_BY_KIND = f""",
ke AS (SELECT *, count(*) OVER w AS n, min(id) OVER w AS group_id, row_number() OVER (PARTITION BY eff, content_hash {_KEEP}) AS r, arg_min(path, string_split(path, '/')) OVER w AS first_path
       FROM al WHERE content_hash IS NOT NULL WINDOW w AS (PARTITION BY eff, content_hash)),
keg AS (SELECT 'exact' AS dup_kind, eff AS scope, group_id, CAST(n AS BIGINT) AS n, max(CASE WHEN r = 1 THEN id END) AS keeper_id, CAST(sum(CASE WHEN r > 1 THEN size END) AS BIGINT) AS reclaimable, 0 AS spread, any_value(first_path) AS first_path FROM ke WHERE n > 1 GROUP BY eff, group_id, n),
kp AS (SELECT DISTINCT eff, phash FROM al WHERE phash IS NOT NULL),
karc AS (SELECT a.eff, a.phash AS a, b.phash AS b FROM kp a JOIN kp b ON a.eff = b.eff AND a.phash <> b.phash AND bit_count(xor(a.phash, b.phash)) <= 6),
kreach AS (SELECT eff, phash AS a, phash AS b FROM kp UNION SELECT r.eff, r.a, arc.b FROM kreach r JOIN karc arc ON r.eff = arc.eff AND r.b = arc.a),
kroot AS (SELECT eff, a AS phash, min(b) AS root FROM kreach GROUP BY ALL),
kn0 AS (SELECT al.*, root FROM al JOIN kroot USING (eff, phash)),
kok AS (SELECT eff, root FROM kn0 GROUP BY ALL HAVING count(*) > 1 AND NOT (count(content_hash) = count(*) AND min(content_hash) = max(content_hash))),
kn AS (SELECT *, count(*) OVER (PARTITION BY eff, root) AS n, min(id) OVER (PARTITION BY eff, root) AS group_id, row_number() OVER (PARTITION BY eff, root {_KEEP}) AS r FROM kn0 WHERE (eff, root) IN (SELECT (eff, root) FROM kok)),
ksp AS (SELECT a.eff, a.root, max(bit_count(xor(a.phash, b.phash))) AS spread FROM (SELECT DISTINCT eff, root, phash FROM kn) a JOIN (SELECT DISTINCT eff, root, phash FROM kn) b USING (eff, root) GROUP BY ALL),
kng AS (SELECT 'near' AS dup_kind, eff AS scope, group_id, CAST(n AS BIGINT) AS n, max(CASE WHEN r = 1 THEN id END) AS keeper_id, CAST(sum(CASE WHEN r > 1 THEN size END) AS BIGINT) AS reclaimable, CAST(any_value(spread) AS INT) AS spread, arg_min(path, string_split(path, '/')) AS first_path
        FROM kn JOIN ksp USING (eff, root) GROUP BY eff, group_id, n),
kb0 AS (SELECT *, coalesce(camera_model, '') AS cam, CASE WHEN date_taken - lag(date_taken) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM al WHERE date_taken IS NOT NULL WINDOW w AS (PARTITION BY eff, coalesce(camera_model, '') ORDER BY date_taken, path)),
kb1 AS (SELECT *, sum(fresh) OVER (PARTITION BY eff, cam ORDER BY date_taken, path) AS run FROM kb0),
kb2 AS (SELECT eff, cam, run FROM kb1 GROUP BY ALL HAVING count(*) > 1 AND NOT (count(content_hash) = count(*) AND min(content_hash) = max(content_hash))),
kb AS (SELECT kb1.*, row_number() OVER (PARTITION BY eff, cam, run {_KEEP}) AS r FROM kb1 WHERE (eff, cam, run) IN (SELECT (eff, cam, run) FROM kb2)),
kbg AS (SELECT 'burst' AS dup_kind, eff AS scope, min(id) AS group_id, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN r = 1 THEN id END) AS keeper_id, CAST(sum(CASE WHEN r > 1 THEN size END) AS BIGINT) AS reclaimable, 0 AS spread, arg_min(path, string_split(path, '/')) AS first_path FROM kb GROUP BY eff, cam, run)"""
_ORDERED = "SELECT *, CAST(row_number() OVER (ORDER BY CASE dup_kind WHEN 'exact' THEN 0 WHEN 'near' THEN 1 ELSE 2 END, reclaimable DESC, string_split(first_path, '/'), group_id, scope) AS BIGINT) AS rank FROM "
_SCOPED = ["dup_kind", "scope", *_GROUP.split(", ")[1:]]


@query("near_groups_by_kind", "SELECT * FROM kng", _CTE + _BY_KIND, recursive=True)
def near_groups_by_kind(spark, sf):
    return d.groups(d.near_members(_present(spark, sf), by_kind=True)).select(*_SCOPED)


@query("dup_report_by_kind", _ORDERED + "(FROM keg UNION ALL FROM kng)", _CTE + _BY_KIND, recursive=True)
def dup_report_by_kind(spark, sf):
    """The report as it is made by default: exact and near groups, kinds of pictures apart."""
    return d.report(d.all_members(_present(spark, sf))).select(*_SCOPED, "rank")


@query("dup_report_bursts", _ORDERED + "(FROM keg UNION ALL FROM kng UNION ALL FROM kbg)", _CTE + _BY_KIND, recursive=True)
def dup_report_bursts(spark, sf):
    """The report with bursts."""
    return d.report(d.all_members(_present(spark, sf), find=(d.EXACT, d.NEAR, d.BURST))).select(*_SCOPED, "rank")


@query("dup_totals_by_kind", "SELECT dup_kind, CAST(count(*) AS BIGINT) AS groups, CAST(sum(reclaimable) AS BIGINT) AS reclaimable, CAST(sum(n - 1) AS BIGINT) AS removable FROM (FROM keg UNION ALL FROM kng UNION ALL FROM kbg) GROUP BY 1", _CTE + _BY_KIND, recursive=True)
def dup_totals_by_kind(spark, sf):
    return d.totals(d.groups(d.all_members(_present(spark, sf), find=(d.EXACT, d.NEAR, d.BURST))))
