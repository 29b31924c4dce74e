"""E: sampling, de-duplication, splitting and balancing of the whole flow table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions.scaling import order_hash
from netsift.operators import neighbours
from netsift.operators import sampling as E
from netsift.plans import views as V
from netsift.plans.cleaning import CATS_SQL, clean_flows
from netsift.plans.registry import query

_H = "md5(flow_id || '|42')"


def targets(spark, sf_dir):
    """Flows with a clean class, only the columns the sampling needs."""
    return clean_flows(spark, sf_dir).select("flow_id", "cat", "label", "attack_cat", "sbytes", "spkts", "sttl", "proto", "service")


def caps(spark, sf_dir):
    """Class caps in proportion to the table, so that they bite at every scale."""
    n = V.table(spark, sf_dir, "lineitem").count()
    return {"Normal": n // 8, "Exploits": n // 12, "DoS": n // 5}


@query("e1_class_caps", f"""WITH {CATS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY {_H}) AS rn, (SELECT count(*) FROM lineitem) AS total FROM cats)
SELECT cat, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM r
WHERE CASE cat WHEN 'Normal' THEN rn <= total // 8 WHEN 'Exploits' THEN rn <= total // 12 WHEN 'DoS' THEN rn <= total // 5 ELSE true END GROUP BY cat""")
def e1(spark, sf_dir):
    capped = E.cap_classes(targets(spark, sf_dir), "cat", ["flow_id"], caps(spark, sf_dir))
    return capped.groupBy("cat").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


SUBSET_SQL = V.FLOWS_SQL + f""", tgt AS (SELECT least(greatest(1, CAST(floor((SELECT count(*) FROM flows WHERE label = 1) * 0.2) AS BIGINT) - 500),
    greatest(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT CASE WHEN c IN ('-','normal') THEN 'unknown' ELSE c END AS c FROM (
      SELECT lower(trim(coalesce(attack_cat,'Unknown'))) AS c FROM flows WHERE label = 1)) GROUP BY c)) - 500)) AS k),
subset AS (SELECT *, row_number() OVER (ORDER BY {_H}) AS shuffle_rank FROM (SELECT * FROM flows WHERE label = 1
  UNION ALL SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY {_H}) AS rn FROM flows WHERE label = 0) WHERE rn <= (SELECT k FROM tgt)))"""


@query("e2_attack_normal_subset", f"WITH {SUBSET_SQL} SELECT label, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes, CAST(sum(shuffle_rank * (spkts % 7)) AS BIGINT) AS ranks FROM subset GROUP BY label")
def e2(spark, sf_dir):
    f = V.flows(spark, sf_dir).select("flow_id", "label", "attack_cat", "sbytes", "spkts")
    s = E.attack_normal_subset(f, ["flow_id"], 0.2, 500)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"), F.sum(F.col("shuffle_rank") * (F.col("spkts") % 7)).alias("ranks"))


@query("e3_seeded_shuffle", f"WITH {V.FLOWS_SQL} SELECT flow_id, row_number() OVER (ORDER BY {_H}) AS shuffle_rank FROM flows")
def e3(spark, sf_dir):
    return E.shuffle(V.flows(spark, sf_dir).select("flow_id"), ["flow_id"])


@query("e4_duplicate_removal", f"""WITH {CATS_SQL}, d AS (SELECT spkts, sttl, proto, service, cat, flow_id, row_number() OVER (PARTITION BY spkts, sttl, proto, service ORDER BY {_H}) AS rn FROM cats)
SELECT spkts, sttl, proto, service, cat, flow_id FROM d WHERE rn = 1""")
def e4(spark, sf_dir):
    t = targets(spark, sf_dir).withColumn("h", order_hash("flow_id"))
    return E.drop_duplicates(t.select("spkts", "sttl", "proto", "service", "cat", "flow_id", "h"), ["spkts", "sttl", "proto", "service"], "h").drop("h")


SPLIT_SQL = CATS_SQL + f""", cc AS (SELECT cat, count(*) AS n FROM cats GROUP BY cat), tot AS (SELECT sum(n) AS n, sum(n) - ceil(sum(n) * 0.2) AS tr FROM cc),
q AS (SELECT cat, floor(s) + CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, cat) <= (SELECT tr FROM tot) - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS train
  FROM (SELECT cat, n * (SELECT tr FROM tot) / (SELECT n FROM tot) AS s FROM cc)),
splits AS (SELECT c.*, CASE WHEN rn <= train THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY {_H}) AS rn FROM cats) c JOIN q USING (cat))"""


@query("e5_stratified_split", f"WITH {SPLIT_SQL} SELECT split, cat, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM splits GROUP BY 1, 2")
def e5(spark, sf_dir):
    s = E.stratified_split(targets(spark, sf_dir), "cat", ["flow_id"])
    return s.groupBy("split", "cat").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


# Classes with a few rare members: the largest flows get a class of their own.
_RARE = "CASE WHEN sbytes > 10490000 THEN 'big' || (sbytes % 40) ELSE cat END"


@query("e6_three_way_split", f"""WITH {CATS_SQL}, cls AS (SELECT flow_id, sbytes, {_RARE} AS k FROM cats), st AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) < 3 THEN 'RARE' ELSE k END AS strat FROM cls),
cc AS (SELECT strat, count(*) AS n FROM st GROUP BY strat HAVING NOT (strat = 'RARE' AND count(*) < 2)),
tot AS (SELECT sum(n) AS n, ceil(sum(n) * 0.6) AS tmp, ceil(ceil(sum(n) * 0.6) * 2 / 3) AS test FROM cc),
q1 AS (SELECT strat, n, floor(s) + CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, strat) <= (SELECT n - tmp FROM tot) - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS train
  FROM (SELECT strat, n, CAST(n AS DOUBLE) * (SELECT CAST(n - tmp AS DOUBLE) FROM tot) / (SELECT CAST(n AS DOUBLE) FROM tot) AS s FROM cc)),
q2 AS (SELECT strat, train, floor(s) + CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, strat) <= (SELECT tmp - test FROM tot) - sum(floor(s)) OVER () THEN 1 ELSE 0 END AS val
  FROM (SELECT strat, train, (n - train) * (SELECT CAST(tmp - test AS DOUBLE) FROM tot) / (SELECT CAST(tmp AS DOUBLE) FROM tot) AS s FROM q1))
SELECT split, k, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM (
  SELECT k, sbytes, CASE WHEN rn <= train THEN 'train' WHEN rn <= train + val THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY strat ORDER BY {_H}) AS rn FROM st) JOIN q2 USING (strat)) GROUP BY 1, 2""")
def e6(spark, sf_dir):
    t = targets(spark, sf_dir).withColumn("k", F.expr(_RARE)).select("flow_id", "sbytes", "k")
    s = E.three_way_split(t, "k", ["flow_id"])
    return s.groupBy("split", "k").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


@query("e7_class_codes", f"""WITH {CATS_SQL}, f AS (SELECT cat, min({_H}) AS h FROM cats GROUP BY cat), r AS (
  SELECT cat, row_number() OVER (ORDER BY h) - 1 AS first_seen, row_number() OVER (ORDER BY cat) - 1 AS alphabetical FROM f)
SELECT first_seen, alphabetical, count(*) AS n FROM cats JOIN r USING (cat) GROUP BY 1, 2""")
def e7(spark, sf_dir):
    t = targets(spark, sf_dir).withColumn("h", order_hash("flow_id"))
    out = E.encode_classes(t, "cat", E.class_codes(t, "cat", "h"), "first_seen")
    out = E.encode_classes(out, "cat", E.class_codes(t, "cat"), "alphabetical")
    return out.groupBy("first_seen", "alphabetical").agg(F.count("*").alias("n"))


@query("e8_undersample", f"""WITH {CATS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY {_H}) AS rn FROM cats), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM cats GROUP BY cat))
SELECT cat, count(*) AS n, CAST(sum(sbytes) AS BIGINT) AS bytes FROM r WHERE rn <= (SELECT n FROM m) GROUP BY cat""")
def e8(spark, sf_dir):
    u = E.undersample(targets(spark, sf_dir), "cat", ["flow_id"])
    return u.groupBy("cat").agg(F.count("*").alias("n"), F.sum("sbytes").alias("bytes"))


@query("e12_balanced_weights", f"""WITH {CATS_SQL}, cc AS (SELECT cat, count(*) AS n FROM cats GROUP BY cat)
SELECT cat, count(*) AS n, round(avg((SELECT sum(n) FROM cc) / ((SELECT count(*) FROM cc) * cc.n)), 6) AS weight FROM cats JOIN cc USING (cat) GROUP BY cat""")
def e12(spark, sf_dir):
    w = E.balanced_weights(targets(spark, sf_dir), "cat")
    return w.groupBy("cat").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


def points(spark, sf_dir):
    """Labelled vectors, the minority classes thinned so that classes differ in size."""
    e = V.table(spark, sf_dir, "embeddings")
    return e.select(F.format_string("%08d", "vec_id").alias("id"), (F.col("label") % 3).cast("string").alias("cls"),
                    F.col("embedding").cast("array<double>").alias("vec"))


_POINTS = "pts AS (SELECT printf('%08d', vec_id) AS id, CAST(label % 3 AS VARCHAR) AS cls, embedding::DOUBLE[] AS vec FROM embeddings)"
_NEAR = """nn AS (SELECT a.id, a.cls, b.id AS nid, b.cls AS ncls, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: pow(z[1] - z[2], 2)))) AS d
  FROM pts a JOIN pts b ON a.id <> b.id {cond}), tk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nid) AS rank FROM nn)"""


@query("e9_class_neighbours", f"WITH {_POINTS}, {_NEAR.format(cond='AND a.cls = b.cls')} SELECT id, rank, nid AS neighbour, round(d, 6) AS distance FROM tk WHERE rank <= 5")
def e9_neighbours(spark, sf_dir):
    p = points(spark, sf_dir).select("id", F.col("cls").alias("scope"), "cls", "vec", F.lit(True).alias("q"), F.lit(True).alias("s"))
    return neighbours.nearest(p, 5).select("id", F.col("rank").cast("long").alias("rank"), "neighbour", F.round("distance", 6).alias("distance"))


@query("e9_smote", f"WITH {_POINTS}, c AS (SELECT cls, count(*) AS n FROM pts GROUP BY cls) SELECT cls, (SELECT max(n) FROM c) - n AS n FROM c WHERE n < (SELECT max(n) FROM c)")
def e9(spark, sf_dir):
    return neighbours.smote(points(spark, sf_dir)).groupBy("cls").agg(F.count("*").alias("n"))


_DANGER = f"WITH {_POINTS}, {_NEAR.format(cond='')}, fr AS (SELECT id, cls, count(*) FILTER (ncls <> cls) AS f FROM tk WHERE rank <= 10 GROUP BY id, cls), small AS (SELECT cls FROM pts GROUP BY cls HAVING count(*) < (SELECT count(*) * 0.4 FROM pts)), dg AS (SELECT * FROM fr WHERE f >= 5 AND f < 10 AND cls IN (SELECT cls FROM small))"


@query("e10_danger_rows", f"{_DANGER} SELECT id, cls, f AS foreign FROM dg")
def e10_danger(spark, sf_dir):
    p = points(spark, sf_dir)
    n = p.count()
    small = [r["cls"] for r in p.groupBy("cls").count().collect() if r["count"] < n * 0.4]
    return neighbours.danger_rows(p, small).select("id", "cls", "foreign")


@query("e10_borderline_smote", f"{_DANGER}, c AS (SELECT cls, count(*) AS n FROM pts GROUP BY cls) SELECT cls, CAST(floor((SELECT count(*) FROM pts) * 0.4) AS BIGINT) - n AS n FROM c WHERE cls IN (SELECT cls FROM dg)")
def e10(spark, sf_dir):
    p = points(spark, sf_dir)
    return neighbours.borderline_smote(p, int(p.count() * 0.4)).groupBy("cls").agg(F.count("*").alias("n"))


@query("e11_adasyn_quota", f"""WITH {_POINTS}, {_NEAR.format(cond='')}, fr AS (SELECT id, cls, count(*) FILTER (ncls <> cls) / 5 AS ratio FROM tk WHERE rank <= 5 GROUP BY id, cls), c AS (SELECT cls, count(*) AS n FROM pts GROUP BY cls)
SELECT id, cls, round(ratio, 6) AS ratio, CAST(round_even(ratio / sum(ratio) OVER (PARTITION BY cls) * ((SELECT max(n) FROM c) - n), 0) AS BIGINT) AS copies FROM fr JOIN c USING (cls) WHERE n < (SELECT max(n) FROM c)""")
def e11_quota(spark, sf_dir):
    return neighbours.adasyn_quota(points(spark, sf_dir)).select("id", "cls", F.round("ratio", 6).alias("ratio"), "copies")


_QUOTA = "fr AS (SELECT id, cls, count(*) FILTER (ncls <> cls) / 5 AS ratio FROM tk WHERE rank <= 5 GROUP BY id, cls), qt AS (SELECT id, cls, CAST(round_even(ratio / sum(ratio) OVER (PARTITION BY cls) * ((SELECT max(n) FROM c) - n), 0) AS BIGINT) AS copies FROM fr JOIN c USING (cls) WHERE n < (SELECT max(n) FROM c))"
_CLASSES = "c AS (SELECT cls, count(*) AS n FROM pts GROUP BY cls)"


@query("e11_adasyn", f"WITH {_POINTS}, {_NEAR.format(cond='')}, {_CLASSES}, {_QUOTA} SELECT cls, CAST(sum(copies) AS BIGINT) AS n FROM qt WHERE copies > 0 GROUP BY cls")
def e11(spark, sf_dir):
    return neighbours.adasyn(points(spark, sf_dir)).groupBy("cls").agg(F.count("*").alias("n"))


def _even_sql(seeds: str, target: str) -> str:
    """The copies of every seed row: those a class is short of, dealt evenly, the rest in hash order."""
    return f"""sr AS (SELECT id, cls, row_number() OVER (PARTITION BY cls ORDER BY md5(id || '|42')) AS r, count(*) OVER (PARTITION BY cls) AS m FROM {seeds}),
qt AS (SELECT id, cls, (w // m) + CAST(r <= w % m AS BIGINT) AS copies FROM (SELECT sr.*, {target} - n AS w FROM sr JOIN c USING (cls) WHERE n < {target}))"""


def _draw(what: str) -> str:
    return f"CAST('0x' || substr(md5(id || '|' || copy || '|{what}42'), 1, 8) AS BIGINT) / 4294967296.0"


# the synthetic rows themselves: seed, neighbour and position on the segment, and the vector by its sum and last entry
_ROWS_SQL = f"""lk AS (SELECT a.id, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: pow(z[1] - z[2], 2)))), b.id) AS rank
  FROM pts a JOIN pts b ON a.id <> b.id AND a.cls = b.cls QUALIFY rank <= 5), sz AS (SELECT id, max(rank) AS k FROM lk GROUP BY id),
dr AS (SELECT id, cls, k, unnest(range(1, copies + 1)) AS copy FROM qt JOIN sz USING (id) WHERE copies > 0),
pk AS (SELECT dr.*, CAST(floor({_draw('n')} * k) AS BIGINT) + 1 AS rank, {_draw('g')} AS gap FROM dr),
sy AS (SELECT pk.id || '#' || copy AS id, pk.cls, pk.id AS seed_id, neighbour, gap, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + gap * (z[2] - z[1])) AS vec
  FROM pk JOIN lk ON lk.id = pk.id AND lk.rank = pk.rank JOIN pts a ON a.id = pk.id JOIN pts b ON b.id = neighbour)
SELECT id, cls, seed_id, neighbour, round(gap, 6) AS gap, round(list_sum(vec), 5) AS total, round(vec[-1], 5) AS last FROM sy"""


def _rows(synthetic):
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)
    return synthetic.select("id", "cls", "seed_id", "neighbour", F.round("gap", 6).alias("gap"), F.round(total, 5).alias("total"), F.round(F.element_at("vec", -1), 5).alias("last"))


@query("e9_smote_rows", f"WITH {_POINTS}, {_CLASSES}, {_even_sql('pts', '(SELECT max(n) FROM c)')}, {_ROWS_SQL}")
def e9_rows(spark, sf_dir):
    return _rows(neighbours.smote(points(spark, sf_dir)))


@query("e10_borderline_rows", f"{_DANGER}, {_CLASSES}, {_even_sql('dg', '(SELECT CAST(floor(count(*) * 0.4) AS BIGINT) FROM pts)')}, {_ROWS_SQL}")
def e10_rows(spark, sf_dir):
    p = points(spark, sf_dir)
    return _rows(neighbours.borderline_smote(p, int(p.count() * 0.4)))


@query("e11_adasyn_rows", f"WITH {_POINTS}, {_NEAR.format(cond='')}, {_CLASSES}, {_QUOTA}, {_ROWS_SQL}")
def e11_rows(spark, sf_dir):
    return _rows(neighbours.adasyn(points(spark, sf_dir)))


def flow_points(spark, sf_dir):
    """Flows as vectors of five measurements on a logarithmic scale, all in one scope."""
    f = clean_flows(spark, sf_dir)
    measured = F.array(*[F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in ("sbytes", "dbytes", "spkts", "dpkts", "dur")])
    return f.select(F.col("flow_id").cast("string").alias("id"), F.lit("all").alias("scope"), F.col("cat").alias("cls"), measured.alias("vec"), F.lit(True).alias("q"), F.lit(True).alias("s"))


@query("e9_search_cost")
def e9_cost(spark, sf_dir):
    # all flows against all flows: the pairs compared, against those there are (tests hold the neighbours against brute force)
    return neighbours.search_cost(flow_points(spark, sf_dir), 5)
