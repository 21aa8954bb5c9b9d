"""Queries of the interval operators with theta-join and window oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import intervals as iv

from .shapes import shape, sql

Q: dict = {}
SQL: dict = {}


def query(name: str, *shapes: str, oracle: str | None = None):
    """Registers f(*shapes) under `name`, with an oracle that may use the same shapes."""

    def add(f):
        Q[name] = lambda spark, sf_dir: f(*[shape(spark, sf_dir, s) for s in shapes])
        if oracle:
            SQL[name] = sql(*shapes) + oracle
        return f

    return add


PAIR = 'l.chrom = f.chrom AND f.start <= l."end" AND f."end" >= l.start'
OVER = 'least(l."end", f."end") - greatest(l.start, f.start) + 1'


@query("j1_interval_overlap_join", "loci", "features", oracle=f"SELECT f.feat_id, count(*) AS n_loci, CAST(sum({OVER}) AS BIGINT) AS bases FROM loci l JOIN features f ON {PAIR} GROUP BY f.feat_id")
def _(loci, features):
    return iv.overlap_totals(loci, features, {"all": F.lit(1)}).where("n_all > 0").groupBy("feat_id").agg(F.sum("n_all").alias("n_loci"), F.sum("bases_all").alias("bases"))


@query("j2_interval_semi_join", "sparse", "features", oracle=f'SELECT l.el_id, l.chrom, l.start, l."end" FROM sparse l WHERE EXISTS (SELECT 1 FROM features f WHERE {PAIR})')
def _(loci, features):
    return iv.overlap_join(loci, features, "left_semi").select("el_id", "chrom", "start", "end")


@query("j3_interval_anti_join", "sparse", "features", oracle=f'SELECT l.el_id, l.chrom, l.start, l."end" FROM sparse l WHERE NOT EXISTS (SELECT 1 FROM features f WHERE {PAIR})')
def _(loci, features):
    return iv.overlap_join(loci, features, "left_anti").select("el_id", "chrom", "start", "end")


@query("f7_include_exclude_loci", "sparse", "features", oracle=f"SELECT l.el_id FROM sparse l WHERE EXISTS (SELECT 1 FROM features f WHERE f.score < 500 AND {PAIR}) AND NOT EXISTS (SELECT 1 FROM features f WHERE f.score >= 900 AND {PAIR})")
def _(loci, features):
    kept = iv.overlap_join(loci, features.where("score >= 900"), "left_anti")
    return iv.overlap_join(kept, features.where("score < 500"), "left_semi").select("el_id")


def _flank(side: str) -> str:
    before = "'+'" if side == "up" else "'-'"
    return f"""SELECT f.feat_id, count(*) AS n FROM sparse l JOIN features f ON l.chrom = f.chrom AND
 CASE WHEN f.strand = {before} THEN l."end" >= greatest(f.start - 200, 0) AND l.start <= f.start - 1 ELSE l.start <= f."end" + 200 AND l."end" >= f."end" + 1 END GROUP BY f.feat_id"""


@query("j4_upstream_window_join", "sparse", "features", oracle=_flank("up"))
def _(loci, features):
    return iv.overlap_totals(loci, iv.flanks(features, 200, "up"), {"all": F.lit(1)}).where("n_all > 0").groupBy("feat_id").agg(F.sum("n_all").alias("n"))


@query("j4_downstream_window_join", "sparse", "features", oracle=_flank("down"))
def _(loci, features):
    return iv.overlap_totals(loci, iv.flanks(features, 200, "down"), {"all": F.lit(1)}).where("n_all > 0").groupBy("feat_id").agg(F.sum("n_all").alias("n"))


@query("j5_nearest_feature_join", "sparse", "features", oracle="""SELECT l.el_id,
 (SELECT f.feat_id FROM features f WHERE f.chrom = l.chrom AND f.start > l."end" ORDER BY f.start, f.feat_id LIMIT 1) AS next_feat_id,
 (SELECT f.feat_id FROM features f WHERE f.chrom = l.chrom AND f."end" < l.start ORDER BY f."end" DESC, f.feat_id LIMIT 1) AS prev_feat_id FROM sparse l""")
def _(loci, features):
    return iv.nearest(loci, features).select("el_id", "next_feat_id", "prev_feat_id")


@query("j6_nearest_with_distances", "sparse", "features", oracle=f"""SELECT l.el_id, CASE WHEN h.el_id IS NOT NULL THEN 0 ELSE
 (SELECT min(f.start - l."end") FROM features f WHERE f.chrom = l.chrom AND f.start > l."end") END AS ds_dist, CASE WHEN h.el_id IS NOT NULL THEN 0 ELSE
 (SELECT min(l.start - f."end") FROM features f WHERE f.chrom = l.chrom AND f."end" < l.start) END AS us_dist
 FROM sparse l LEFT JOIN (SELECT DISTINCT el_id FROM sparse l JOIN features f ON {PAIR}) h ON h.el_id = l.el_id""")
def _(loci, features):
    hit = iv.overlap_join(loci, features).select("el_id").distinct().withColumn("_hit", F.lit(True))
    near = iv.nearest(loci, features).join(hit, "el_id", "left")
    zero = F.col("_hit").isNotNull()
    return near.select("el_id", F.when(zero, 0).otherwise(F.col("next_start") - F.col("end")).cast("long").alias("ds_dist"), F.when(zero, 0).otherwise(F.col("start") - F.col("prev_end")).cast("long").alias("us_dist"))


@query("j7_fallback_nearest", "sparse", "features", oracle="""SELECT el_id, CASE WHEN nd < pd OR pd IS NULL THEN nf ELSE pf END AS feat_id FROM (SELECT l.el_id,
 (SELECT f.feat_id FROM features f WHERE f.chrom = l.chrom AND f.start > l."end" ORDER BY f.start, f.feat_id LIMIT 1) AS nf, (SELECT min(f.start) - l."end" FROM features f WHERE f.chrom = l.chrom AND f.start > l."end") AS nd,
 (SELECT f.feat_id FROM features f WHERE f.chrom = l.chrom AND f."end" < l.start ORDER BY f."end" DESC, f.feat_id LIMIT 1) AS pf, (SELECT l.start - max(f."end") FROM features f WHERE f.chrom = l.chrom AND f."end" < l.start) AS pd FROM sparse l)""")
def _(loci, features):
    near = iv.nearest(loci, features)
    after, before = F.col("next_start") - F.col("end"), F.col("start") - F.col("prev_end")
    return near.select("el_id", F.when((after < before) | before.isNull(), F.col("next_feat_id")).otherwise(F.col("prev_feat_id")).alias("feat_id"))


def _merge_sql(table: str, by: str, sep: int, least: int = 0) -> str:
    return f"""SELECT {by}, min(start) AS start, max("end") AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {sep} OR row_number() OVER (PARTITION BY {by} ORDER BY start, "end") = 1 THEN 1 ELSE 0 END AS new FROM {table}))
 GROUP BY {by}, g HAVING max("end") - min(start) + 1 >= {least}"""


@query("r1_merge_features", "sparse", oracle=_merge_sql("sparse", "chrom", 0))
def _(loci):
    return iv.merge(loci)


@query("r1_merge_features_by_strand", "sparse", oracle=_merge_sql("sparse", "chrom, strand", 20, 30))
def _(loci):
    return iv.merge(loci, 20, ("chrom", "strand"), 30)


@query("r11_cluster_within_distance", "sparse", oracle=_merge_sql("sparse", "chrom", 500))
def _(loci):
    return iv.merge(loci, 500)


def _set_sql(test: str, join: int = 0, ref_extend: int = 0, rel_extend: int = 0, extra: str = "") -> str:
    return f"""SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY chrom ORDER BY start) - 1 <= {join}, false) THEN 0 ELSE 1 END AS new FROM
 (SELECT chrom, pos AS start, nxt - 1 AS "end" FROM (SELECT chrom, pos, lead(pos) OVER w AS nxt, sum(a) OVER w > 0 AS a, sum(b) OVER w > 0 AS b FROM
 (SELECT chrom, pos, sum(a) AS a, sum(b) AS b FROM (SELECT chrom, greatest(start - {ref_extend}, 0) AS pos, 1 AS a, 0 AS b FROM sparse UNION ALL SELECT chrom, "end" + {ref_extend} + 1, -1, 0 FROM sparse
  UNION ALL SELECT chrom, greatest(start * 30 - {rel_extend}, 0), 0, 1 FROM features UNION ALL SELECT chrom, start * 30 + ("end" - start) + {rel_extend} + 1, 0, -1 FROM features {extra}) GROUP BY chrom, pos)
  WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE nxt IS NOT NULL AND ({test})))) GROUP BY chrom, g"""


def _spread(features):
    return features.select("chrom", (F.col("start") * 30).alias("start"), (F.col("start") * 30 + F.col("end") - F.col("start")).alias("end"))


def _register_set(name: str, kind: str, test: str, **opts) -> None:
    extra = "UNION ALL SELECT DISTINCT chrom, 0, 0, 0 FROM sparse UNION ALL SELECT DISTINCT chrom, 0, 0, 0 FROM features" if kind == "neither" else ""

    @query(name, "sparse", "features", oracle=_set_sql(test, opts.get("join_distance", 0), opts.get("ref_extend", 0), opts.get("rel_extend", 0), extra))
    def _(loci, features):
        return iv.set_operation(loci, _spread(features), kind, **opts)


_register_set("r2_intersect", "intersect", "a AND b")
_register_set("r3_ref_exclusive", "ref_only", "a AND NOT b")
_register_set("r3_rel_exclusive", "rel_only", "b AND NOT a")
_register_set("r4_union", "union", "a OR b")
_register_set("r5_neither", "neither", "NOT a AND NOT b")
_register_set("r6_union_join_distance", "union", "a OR b", join_distance=100)
_register_set("r7_flank_extended_intersect", "intersect", "a AND b", ref_extend=50, rel_extend=25)


@query("r8_dedupe_elements", "sparse", oracle="""SELECT el_id, chrom, start, "end", strand FROM (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY start, "end" DESC, el_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sparse) WHERE m IS NULL OR "end" > m""")
def _(loci):
    return iv.dedupe(loci).select("el_id", "chrom", "start", "end", "strand")


@query("r8_join_near_elements", "sparse", oracle="""SELECT chrom, strand, min(start) AS start, arg_max("end", start * 1000 + ("end" - start)) AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY chrom, strand ORDER BY start, "end", el_id ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, CASE WHEN coalesce(start - lag(start) OVER (PARTITION BY chrom, strand ORDER BY start, "end", el_id) <= 40, false) THEN 0 ELSE 1 END AS new FROM sparse)) GROUP BY chrom, strand, g""")
def _(loci):
    return iv.join_near(loci, 40)


@query("r9_not_overlapped", "sparse", oracle="""SELECT a.el_id FROM sparse a WHERE NOT EXISTS (SELECT 1 FROM sparse b WHERE a.chrom = b.chrom AND a.el_id <> b.el_id AND b.start <= a."end" AND b."end" >= a.start)""")
def _(loci):
    hit = iv.overlap_join(loci, loci).where("el_id <> b_el_id").select("el_id").distinct()
    return loci.join(hit, "el_id", "left_anti").select("el_id")


def _elements(kind: str) -> str:
    return f"""SELECT l.el_id FROM sparse l WHERE {"" if kind == "intersect" else "NOT"} EXISTS (SELECT 1 FROM features f WHERE {PAIR} AND {OVER} >= 5 AND 100.0 * ({OVER}) >= 50.0 * (l."end" - l.start + 1))"""


@query("r10_elements_intersect", "sparse", "features", oracle=_elements("intersect"))
def _(loci, features):
    return iv.element_sets(loci, features, "intersect", 5, 50.0).select("el_id")


@query("r10_element_dropouts", "sparse", "features", oracle=_elements("dropouts"))
def _(loci, features):
    return iv.element_sets(loci, features, "dropouts", 5, 50.0).select("el_id")


@query("r12_gene_regions", "exons", oracle="""SELECT feat_id, 'exon' AS region, start, "end" FROM exons UNION ALL
 SELECT feat_id, 'intron', pe + 1, start - 1 FROM (SELECT *, lag("end") OVER (PARTITION BY feat_id ORDER BY start) AS pe FROM exons) WHERE pe IS NOT NULL AND start - 1 >= pe + 1 UNION ALL
 SELECT feat_id, 'cds', greatest(start, cds_start), least("end", cds_end) FROM exons WHERE greatest(start, cds_start) <= least("end", cds_end) UNION ALL
 SELECT feat_id, CASE WHEN strand = '+' THEN '5utr' ELSE '3utr' END, start, least("end", cds_start - 1) FROM exons WHERE start <= least("end", cds_start - 1) UNION ALL
 SELECT feat_id, CASE WHEN strand = '+' THEN '3utr' ELSE '5utr' END, greatest(start, cds_end + 1), "end" FROM exons WHERE greatest(start, cds_end + 1) <= "end" """)
def _(exons):
    from strandframe.operators.features import gene_regions

    return gene_regions(exons)


@query("r12_intergenic", "features", oracle="""SELECT chrom, m + 1 AS start, start - 1 AS "end" FROM (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM features) WHERE m IS NOT NULL AND m + 1 <= start - 1""")
def _(features):
    from strandframe.operators.features import intergenic

    return intergenic(features)


@query("r13_split_elements", "loci", oracle="""SELECT el_id, src_id, row_number() OVER (PARTITION BY src_id ORDER BY strand, chrom, start, "end", el_id) AS split_order, row_number() OVER (PARTITION BY src_id ORDER BY strand, chrom, start, "end", el_id) = 1 AS is_first,
 row_number() OVER (PARTITION BY src_id ORDER BY strand, chrom, start, "end", el_id) = count(*) OVER (PARTITION BY src_id) AS is_last FROM (SELECT *, el_id // 80000000000 AS src_id FROM loci)""")
def _(loci):
    from strandframe.operators.features import split_elements

    return split_elements(loci.withColumn("src_id", F.expr("el_id div 80000000000"))).select("el_id", "src_id", "split_order", "is_first", "is_last")


_DEPTH = """SELECT chrom, pos AS start, nxt - 1 AS "end", d AS depth FROM (SELECT chrom, pos, lead(pos) OVER w AS nxt, CAST(sum(d) OVER w AS BIGINT) AS d FROM (SELECT chrom, pos, sum(d) AS d FROM
 (SELECT chrom, start AS pos, 1 AS d FROM {t} UNION ALL SELECT chrom, "end" + 1, -1 FROM {t}) GROUP BY chrom, pos) WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE nxt IS NOT NULL"""


@query("a1_coverage", "loci", oracle=_DEPTH.format(t="loci"))
def _(loci):
    return iv.depth(loci)


@query("a2_regions_of_interest", "sparse", oracle=f"""SELECT chrom, start, "end", reads, reads * 1000.0::DOUBLE / ("end" - start + 1) * 1e6 / total AS bpkm FROM (SELECT chrom, r, min(start) AS start, max(CASE WHEN good >= (len + 1) // 2 THEN "end" END) AS "end", CAST(sum(reads) AS BIGINT) AS reads, max(total) AS total FROM
 (SELECT chrom, r, s, min(start) AS start, max("end") AS "end", sum(depth * ("end" - start + 1)) AS reads, sum(CASE WHEN depth >= 2 THEN "end" - start + 1 ELSE 0 END) AS good, sum("end" - start + 1) AS len, max(total) AS total FROM
 (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 0 THEN 1 ELSE 0 END) OVER w AS s, sum(CASE WHEN gap IS NULL OR gap > 60 THEN 1 ELSE 0 END) OVER w AS r FROM
 (SELECT *, start - lag("end") OVER (PARTITION BY chrom ORDER BY start) - 1 AS gap, sum(depth * ("end" - start + 1)) OVER () AS total FROM ({_DEPTH.format(t="sparse")}) WHERE depth > 0) WINDOW w AS (PARTITION BY chrom ORDER BY start))
 GROUP BY chrom, r, s) GROUP BY chrom, r) WHERE "end" IS NOT NULL AND "end" - start + 1 >= 20""")
def _(loci):
    return iv.regions_of_interest(loci, 60, 2, 20)


@query("w5_gaps_between_features", "features", oracle="""SELECT feat_id, start - lag("end") OVER (PARTITION BY chrom ORDER BY start, "end", feat_id) AS gap_before, lead(start) OVER (PARTITION BY chrom ORDER BY start, "end", feat_id) - "end" AS gap_after FROM features""")
def _(features):
    from strandframe.operators.features import gaps_between

    return gaps_between(features)
