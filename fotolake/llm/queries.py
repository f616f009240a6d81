"""Queries p1, p4, p6, p7, p8 and p9 over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fotolake.llm.groups import connected_groups, counted_pairs
from fotolake.llm.history import history_matches
from fotolake.llm.leaks import RUN_WORDS, leaked_items
from fotolake.llm.mixture import mixture, shares
from fotolake.llm.spans import shared_spans
from fotolake.llm.survivors import PICTURE, Bundle, Dependency, choose_survivors, members_of
from fotolake.runtime import table

#: Columns of `media` that decide survivors.
_RANKED = ["id", "path", "size", "mtime", "date_taken", "camera_model", "width", "height"]
_KEPT = ["id", "path", "size", "mtime", "date_taken", "camera_make", "camera_model", "lens", "iso", "width", "height", "content_hash", "lat", "lon"]
_HAS_CAMERA = "camera_model is not null and trim(camera_model) <> ''"


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "media").where("not missing")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every present media row that counted pairs link to others."""
    pairs = counted_pairs(table(spark, sf_dir, "match_pairs"), table(spark, sf_dir, "media"))
    return connected_groups(pairs).withColumnRenamed("id", "media_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming files with the known files they repeat or nearly repeat."""
    return history_matches(_present(spark, sf_dir), table(spark, sf_dir, "incoming"), radius=6)


def _members(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return members_of(table(spark, sf_dir, "dup_groups"), _present(spark, sf_dir).select(*columns), "group_id", "members", "id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row to keep of each group, and the best member for its date and camera.

    The contract wants the first member by picture that has the field, whatever the others say: three
    bundles without dependencies, for which the search proves each first candidate best.
    """
    bundles = [
        Bundle("keeper", "true", ("path", "size", "width", "height")),
        Bundle("date_taken", "date_taken > 0", ("date_taken",)),
        Bundle("camera_model", _HAS_CAMERA, ("camera_model",)),
    ]
    return choose_survivors(_members(spark, sf_dir, _RANKED), bundles)


def p6_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors built from whole bundles, each with its own trust, that must agree: the same bytes have one size of picture, a camera its own time."""
    whole = "-(cast(camera_make is not null as int) + cast(lens is not null as int) + cast(iso is not null as int))"
    bundles = [
        Bundle("identity", "content_hash is not null", ("content_hash", "size"), 4.0),
        Bundle("picture", "width is not null and height is not null", ("width", "height"), 3.0),
        Bundle("camera", _HAS_CAMERA, ("camera_make", "camera_model", "lens", "iso"), 2.0, (whole, *PICTURE)),
        Bundle("time", "date_taken > 0", ("date_taken",), 2.0, ("mtime", "id")),
        Bundle("place", "lat is not null and lon is not null", ("lat", "lon"), 1.0, ("-mtime", "id")),
    ]
    deps = [Dependency("content_hash", "width"), Dependency("content_hash", "height"), Dependency("camera_model", "date_taken")]
    return choose_survivors(_members(spark, sf_dir, _KEPT), bundles, dependencies=deps)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents that share at least 13 words in a row."""
    leaks = leaked_items(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"), least=None)
    return leaks.where(f"longest_run >= {RUN_WORDS}").select("item_id", "doc_id")


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents that align over at least 0.8 of the item, copied word for word or edited."""
    leaks = leaked_items(table(spark, sf_dir, "eval_items"), table(spark, sf_dir, "documents"), least=0.8)
    return leaks.where("similarity >= 0.8").select("item_id", "doc_id", "longest_run", "score", "similarity")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture the caps allow, in training order."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in that mixture."""
    return shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each document shared with others in stretches of 300 or more."""
    return shared_spans(table(spark, sf_dir, "documents"), min_chars=300)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p4_found, p6_found, p6_bundles, p7_found, p7_edited, p8_mixture, p8_shares, p9_found)}

ORACLE: dict[str, str] = {
    "p1_found": """
WITH RECURSIVE present AS (SELECT DISTINCT id FROM media WHERE NOT missing),
     pair AS (SELECT DISTINCT left_id AS a, right_id AS b FROM match_pairs
              WHERE left_id <> right_id AND (lower(trim(match_method)) = 'exact' OR distance <= 6)
                AND left_id IN (SELECT id FROM present) AND right_id IN (SELECT id FROM present)),
     arc AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
     reach AS (SELECT a, b FROM arc UNION SELECT r.a, arc.b FROM reach r JOIN arc ON r.b = arc.a)
SELECT a AS media_id, least(a, min(b)) AS group_id FROM reach GROUP BY a
""",
    "p4_found": """
WITH h AS (SELECT DISTINCT 0 AS s, id, lower(content_hash) AS c, phash FROM media WHERE NOT missing),
     i AS (SELECT DISTINCT batch_no AS s, id, lower(content_hash) AS c, phash FROM incoming),
     k AS (SELECT * FROM h UNION ALL SELECT * FROM i)
SELECT DISTINCT least(i.id, k.id) AS id_a, greatest(i.id, k.id) AS id_b FROM i JOIN k ON i.s > k.s AND (i.c = k.c OR bit_count(xor(i.phash, k.phash)) <= 6)
""",
    "p6_found": """
WITH m AS (SELECT DISTINCT g.group_id, u.id FROM dup_groups g, unnest(g.members) u(id) WHERE u.id IS NOT NULL),
     p AS (SELECT DISTINCT id, path, size, mtime, date_taken, camera_model, coalesce(CAST(width AS BIGINT) * height, 0) AS area FROM media WHERE NOT missing),
     j AS (SELECT m.group_id, p.*, count(*) OVER (PARTITION BY m.group_id) AS k,
                  row_number() OVER (PARTITION BY m.group_id ORDER BY area DESC, size DESC, mtime, strlen(path), path) AS r FROM m JOIN p ON p.id = m.id),
     f AS (SELECT group_id, 'keeper' AS field_name, id, r FROM j WHERE k >= 2
           UNION ALL SELECT group_id, 'date_taken', id, r FROM j WHERE k >= 2 AND date_taken > 0
           UNION ALL SELECT group_id, 'camera_model', id, r FROM j WHERE k >= 2 AND trim(camera_model) <> '')
SELECT group_id, field_name, arg_min(id, r) AS media_id FROM f GROUP BY ALL
""",
    # every combination of two bundles' candidates and of none; pairs of bundles without dependency between them are chosen apart
    "p6_bundles": """
WITH m AS (SELECT DISTINCT g.group_id, u.id FROM dup_groups g, unnest(g.members) u(id) WHERE u.id IS NOT NULL),
     p AS (SELECT DISTINCT * EXCLUDE (indexed_at) FROM media WHERE NOT missing),
     k AS (SELECT m.group_id, p.*, count(*) OVER (PARTITION BY m.group_id) AS k,
                  row_number() OVER (PARTITION BY m.group_id ORDER BY -coalesce(CAST(width AS BIGINT) * height, 0), -size, mtime, strlen(path), path, p.id) AS pr,
                  (camera_make IS NOT NULL)::INT + (lens IS NOT NULL)::INT + (iso IS NOT NULL)::INT AS n_cam FROM m JOIN p ON p.id = m.id),
     j AS (SELECT * FROM k WHERE k >= 2),
     g AS (SELECT DISTINCT group_id FROM j),
     c1 AS (SELECT group_id, width AS w, height AS h, min({'a': pr, 'id': id}) AS b FROM j WHERE content_hash IS NOT NULL GROUP BY ALL),
     c2 AS (SELECT group_id, width AS w, height AS h, min({'a': pr, 'id': id}) AS b FROM j WHERE width IS NOT NULL AND height IS NOT NULL GROUP BY ALL),
     c3 AS (SELECT group_id, date_taken AS d, min({'a': -n_cam, 'p': pr, 'id': id}) AS b FROM j WHERE trim(camera_model) <> '' GROUP BY ALL),
     c4 AS (SELECT group_id, date_taken AS d, min({'a': mtime, 'id': id}) AS b FROM j WHERE date_taken > 0 GROUP BY ALL),
     r1 AS (SELECT group_id, w, h, b.id AS id, row_number() OVER (PARTITION BY group_id ORDER BY b) - 1 AS r FROM c1 UNION ALL SELECT group_id, NULL, NULL, NULL, 8 FROM g),
     r2 AS (SELECT group_id, w, h, b.id AS id, row_number() OVER (PARTITION BY group_id ORDER BY b) - 1 AS r FROM c2 UNION ALL SELECT group_id, NULL, NULL, NULL, 8 FROM g),
     r3 AS (SELECT group_id, d, b.id AS id, row_number() OVER (PARTITION BY group_id ORDER BY b) - 1 AS r FROM c3 UNION ALL SELECT group_id, NULL, NULL, 8 FROM g),
     r4 AS (SELECT group_id, d, b.id AS id, row_number() OVER (PARTITION BY group_id ORDER BY b) - 1 AS r FROM c4 UNION ALL SELECT group_id, NULL, NULL, 8 FROM g),
     x AS (SELECT a.group_id, a.id AS i1, b.id AS i2 FROM r1 a JOIN r2 b ON a.group_id = b.group_id AND NOT coalesce(a.w <> b.w, false) AND NOT coalesce(a.h <> b.h, false)
           QUALIFY row_number() OVER (PARTITION BY a.group_id ORDER BY 4 * a.r + 3 * b.r, a.r, b.r) = 1),
     y AS (SELECT a.group_id, a.id AS i3, b.id AS i4 FROM r3 a JOIN r4 b ON a.group_id = b.group_id AND NOT coalesce(a.d <> b.d, false)
           QUALIFY row_number() OVER (PARTITION BY a.group_id ORDER BY 2 * a.r + 2 * b.r, a.r, b.r) = 1),
     f AS (SELECT group_id, 'identity' AS field_name, i1 AS media_id FROM x UNION ALL SELECT group_id, 'picture', i2 FROM x UNION ALL SELECT group_id, 'camera', i3 FROM y UNION ALL SELECT group_id, 'time', i4 FROM y
           UNION ALL SELECT group_id, 'place', arg_min(id, (-mtime, id)) FROM j WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY group_id)
SELECT * FROM f WHERE media_id IS NOT NULL
""",
    "p7_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
     dg AS (SELECT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
     ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)
""",
    "p9_found": """
WITH w AS (SELECT doc_id, p, hash(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS p FROM documents WHERE length(text) >= 300)),
     s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
     c AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM w WHERE h IN (SELECT h FROM s))
SELECT doc_id, CAST(sum(least(coalesce(nxt - p, 300), 300)) AS BIGINT) AS shared_chars FROM c GROUP BY doc_id
""",
}
