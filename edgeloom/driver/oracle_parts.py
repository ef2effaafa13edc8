"""SQL building blocks for the oracles: the driver-table mapping and shared steps, as named CTEs."""
from __future__ import annotations

import math

from edgeloom import constants as K
from edgeloom.driver import inputs as I

TOLERANCE = 0.35
UP, DOWN = math.exp(TOLERANCE), math.exp(-TOLERANCE)


def acc(key: str) -> str:
    low, high = f"lpad(CAST(({key}) % 10000000 AS VARCHAR), 7, '0')", f"(({key}) // 10000000)"
    ch = lambda n: f"chr(CAST(65 + {n} AS INTEGER))"                       # noqa: E731
    return (f"({ch(f'{high} % 14')} || substr({low},1,1) || {ch(f'({high}//14) % 26')} || substr({low},2,3) || "
            f"{ch(f'({high}//364) % 26')} || substr({low},5,3))")


def case(col: str, table: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def nth(col: str, values: list[str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values, 1)) + " END"


def norm(x: str) -> str:
    return f"(CASE WHEN ({x}) > 1 THEN ({x}) / 1000.0 ELSE ({x}) END)"


def buckets(loc: str, comp: str) -> str:
    blob = f"lower(coalesce({loc},'') || ' ' || coalesce({comp},''))"
    items = []
    for name in sorted(K.LOCATION_KEYWORDS):
        hit = " OR ".join(f"contains({blob}, '{w}')" for w in K.LOCATION_KEYWORDS[name])
        items.append(f"CASE WHEN {hit} THEN '{name}' END")
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def overlap(a: str, b: str) -> str:
    lone = lambda x: f"(len({x}) = 1 AND {x}[1] IN ('extracellular','nucleus','mitochondrion'))"
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 'unclear' WHEN list_has_any({a}, {b}) THEN 'compatible' "
            f"WHEN {lone(a)} AND {lone(b)} THEN 'conflicting' ELSE 'unclear' END")


def is_pair(a: str = "ra", b: str = "rb") -> str:
    return f"(({a} IN ('a','both') AND {b} IN ('b','both')) OR ({b} IN ('a','both') AND {a} IN ('b','both')))"


def same(x: str, y: str) -> str:
    return " AND ".join(f"{x}.{c} = {y}.{c}" for c in [*PK, "group_id"])


def _found_sql(ranked: str, cell: str) -> str:
    """Slots and drawn pairs with the same number in a cell."""
    return f"""
 SELECT {', '.join('p.' + c for c in [*PK, 'group_id'])}, s.a AS slot_a, s.b AS slot_b, p.a, p.b, abs(ln(p.product + 1.0) - ln(s.product + 1.0)) AS gap
 FROM {ranked} p JOIN {ranked} s ON p.src = 'pool' AND s.src = 'slot' AND p.number = s.number AND {same('p', 's')}
 AND {' AND '.join(f'p.{c} = s.{c}' for c in cell.split(', '))}"""


def left_sql(source: str, found: str) -> str:
    """Rows of both sides that a step did not match."""
    return f"""
 SELECT r.* FROM {source} r ANTI JOIN (SELECT 'pool' AS src, {OWN}, a, b FROM {found}
  UNION ALL SELECT 'slot', {OWN}, slot_a, slot_b FROM {found}) f ON r.src = f.src AND r.a = f.a AND r.b = f.b AND {same('r', 'f')}"""


def cells_sql(name: str, source: str, cell: str) -> dict:
    """One step of the matching by degree product: number by number in hash order inside each cell."""
    return {
        f"{name}_ranked": ([source], f"SELECT *, row_number() OVER (PARTITION BY src, {OWN}, {cell} ORDER BY h, a, b) AS number FROM {source}"),
        f"{name}_found": ([f"{name}_ranked"], _found_sql(f"{name}_ranked", cell)),
        f"{name}_left": ([source, f"{name}_found"], left_sql(source, f"{name}_found")),
    }


def border_sql(name: str, source: str, odd: int) -> dict:
    """Matching over every second border of two bands: slots served in order of their reach, each by the next drawn pair that fits."""
    side = f"{OWN}, block, way"
    return {
        f"{name}_placed": ([source], f"""
 SELECT *, CAST(CASE WHEN src = 'pool' THEN CASE WHEN way THEN product ELSE -product END
   WHEN way THEN floor((product + 1.0::DOUBLE) * {UP!r}::DOUBLE) - 1 ELSE 1 - ceil((product + 1.0::DOUBLE) * {DOWN!r}::DOUBLE) END AS BIGINT) AS x
 FROM (SELECT *, floor((band + {odd}) / 2) AS block, ((CAST(band AS BIGINT) + {odd}) % 2 = 0) = (src = 'slot') AS way FROM {source})"""),
        f"{name}_seen": ([f"{name}_placed"], f"""
 SELECT *, row_number() OVER (PARTITION BY src, {side} ORDER BY x, h, a, b) AS j,
  count(*) FILTER (src = 'pool') OVER (PARTITION BY {side} ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fitting FROM {name}_placed"""),
        f"{name}_served": ([f"{name}_seen"], f"""
 SELECT *, j + least(0, min(fitting - j) OVER (PARTITION BY {side} ORDER BY j ROWS UNBOUNDED PRECEDING)) AS served FROM {name}_seen WHERE src = 'slot'"""),
        f"{name}_ranked": ([f"{name}_seen", f"{name}_served"], f"""
 SELECT * EXCLUDE (j, fitting), j AS number FROM {name}_seen WHERE src = 'pool' UNION ALL
 SELECT * EXCLUDE (j, fitting, served, before), served FROM (
  SELECT *, lag(served, 1, 0) OVER (PARTITION BY {side} ORDER BY j) AS before FROM {name}_served) WHERE served > before"""),
        f"{name}_found": ([f"{name}_ranked"], _found_sql(f"{name}_ranked", "block, way")),
        f"{name}_left": ([source, f"{name}_found"], left_sql(source, f"{name}_found")),
    }


def sizes(n: str, ratios, rule: str) -> tuple[str, str]:
    cut = (lambda x: f"CAST(floor({x}) AS BIGINT)") if rule == "floor" else (
        lambda x: f"CAST(round_even({x}, 0) AS BIGINT)")
    tr, va = cut(f"{n} * CAST({ratios[0]} AS DOUBLE)"), cut(f"{n} * CAST({ratios[1]} AS DOUBLE)")
    short = f"({n} >= 3 AND least({tr}, {va}, {n} - {tr} - {va}) < 1)"
    vu = f"greatest({va}, 1)"
    tu = f"greatest({n} - greatest({tr}, 1) - {vu}, 1)"
    return f"CASE WHEN {short} THEN {n} - {vu} - {tu} ELSE {tr} END", f"CASE WHEN {short} THEN {vu} ELSE {va} END"


def part(n: str, r: str, ratios, rule: str) -> str:
    tr, va = sizes(n, ratios, rule)
    return f"CASE WHEN {r} <= ({tr}) THEN 'train' WHEN {r} <= ({tr}) + ({va}) THEN 'val' ELSE 'test' END"


def hnum(h: str, start: int) -> str:
    return f"CAST('0x' || substr({h}, {start}, 15) AS BIGINT)"


def draws_sql(pos: str, keys: list[str], draws: int) -> str:
    """Distinct allowed pairs drawn from the rows of ``pos``."""
    k = ", ".join(keys)
    h = f"md5(concat_ws('|', {k}, a, b, j))"
    return f"""
 SELECT DISTINCT {k}, group_id, least(l, r) AS a, greatest(l, r) AS b FROM (
  SELECT {k}, d.group_id, x.node_id AS l, y.node_id AS r FROM (
   SELECT {k}, p.group_id, {hnum(h, 1)} % m AS li, {hnum(h, 17)} % m AS ri
   FROM {pos} p JOIN (SELECT group_id, count(*) AS m FROM nodes GROUP BY 1) s ON p.group_id = s.group_id,
        (SELECT unnest(range({draws})) AS j)
  ) d JOIN node_index x ON x.group_id = d.group_id AND x.idx = li
      JOIN node_index y ON y.group_id = d.group_id AND y.idx = ri WHERE li <> ri) q
 WHERE NOT EXISTS (SELECT 1 FROM forbidden f WHERE f.a = least(l, r) AND f.b = greatest(l, r))"""


def take_sql(pool: str, wanted: str, keys: list[str], first: str = "") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"p.{c} = w.{c}" for c in [*keys, "group_id"])
    return f"""
 SELECT {', '.join('p.' + c for c in keys)}, p.a, p.b, p.group_id FROM (
  SELECT *, row_number() OVER (PARTITION BY {k}, group_id ORDER BY {first}md5(concat_ws('|', {k}, a, b)), a, b) AS rk
  FROM {pool}) p JOIN {wanted} w ON {on} WHERE rk <= n"""


SEEDS20 = "(SELECT CAST(unnest(range(20)) AS INTEGER) AS seed)"
PK = ["protocol", "seed", "split"]
OWN = ", ".join([*PK, "group_id"])
RUN = ["protocol", "seed"]

_channel_exprs = {
    "nscore": norm("CASE WHEN l_tax > 0 THEN round(l_tax * 10000) END"),
    "fscore": norm("round(l_discount * 9000)"),
    "pscore": norm("l_quantity * 18"),
    "ascore": norm("CAST(l_linenumber * 130 AS DOUBLE)"),
    "escore": norm("CASE l_returnflag WHEN 'R' THEN 850.0::DOUBLE WHEN 'N' THEN 300.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "dscore": norm("CASE l_linestatus WHEN 'F' THEN 600.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "tscore": norm("CAST(day(l_shipdate) * 30 AS DOUBLE)"),
}
_dominant = "CASE WHEN greatest(" + ", ".join(K.CHANNELS) + ") <= 0 THEN '' " + " ".join(
    f"WHEN {c} >= greatest({', '.join(K.CHANNELS)}) THEN '{K.CHANNEL_LABELS[c]}'"
    for c in sorted(K.CHANNELS, reverse=True)) + " END"

CTES: dict[str, tuple[list[str], str]] = {
    "nodes": ([], f"""
 SELECT p_partkey AS node_id, p_name AS name, p_partkey // {I.SECTION} AS group_id,
  'section ' || CAST(p_partkey // {I.SECTION} AS VARCHAR) AS group_name,
  CASE split_part(p_name,' ',1) WHEN 'hot' THEN 'both' WHEN 'red' THEN 'a' WHEN 'blue' THEN 'b' ELSE 'partner' END AS role,
  {acc('p_partkey')} AS accession, p_type FROM part"""),
    "lines": ([], """
 SELECT *, l_partkey + CAST(l_quantity AS BIGINT) - 1 AS far, round(l_discount * 6000 + l_tax * 5000) AS raw,
  CAST(round(l_tax * 100) AS INTEGER) AS tax FROM lineitem"""),
    "raw_edges": (["lines"], f"""
 SELECT CASE WHEN l_linestatus = 'O' THEN far ELSE l_partkey END AS src,
  CASE WHEN l_linestatus = 'O' THEN l_partkey ELSE far END AS dst, {norm('raw')} AS score FROM lines"""),
    "slim": (["raw_edges", "nodes"], """
 SELECT e.a, e.b, e.score, x.group_id FROM (
  SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(score) AS score FROM raw_edges WHERE src <> dst GROUP BY 1, 2) e
 JOIN nodes x ON x.node_id = e.a JOIN nodes y ON y.node_id = e.b WHERE x.group_id = y.group_id"""),
    "context": (["slim"], "SELECT a, b, score, group_id FROM slim WHERE score >= 0.7"),
    "adj": (["context"], "SELECT a AS u, b AS v FROM context UNION ALL SELECT b, a FROM context"),
    "deg": (["nodes", "adj"], """
 SELECT n.node_id, n.group_id, count(u) AS degree FROM nodes n LEFT JOIN adj ON u = n.node_id GROUP BY 1, 2"""),
    "channel_rows": (["lines"], "SELECT l_partkey AS src, far AS dst, " + norm("raw") + " AS combined, " + ", ".join(
        f"coalesce({e}, 0.0) AS {c}" for c, e in _channel_exprs.items()) + " FROM lines"),
    "channels": (["channel_rows"], f"""
 SELECT *, {_dominant} AS dominant_channel FROM (
  SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY combined DESC, {', '.join(c + ' DESC' for c in K.CHANNELS)}) AS rn
  FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, * FROM channel_rows WHERE src <> dst)) WHERE rn = 1"""),
    "hits_a": (["lines", "nodes"], f"""
 SELECT least(x, far) AS a, greatest(x, far) AS b, 'a' AS source, {nth('l_linenumber', I.ASSAYS)} AS system,
  CASE WHEN l_returnflag = 'R' AND tax >= 7 THEN 'physical' WHEN l_returnflag = 'A' AND tax >= 5 THEN 'genetic' ELSE 'other' END AS kind,
  '' AS method, '' AS itype, [CAST(l_orderkey + 1000000 AS VARCHAR)] AS pubs,
  CASE l_linestatus WHEN 'F' THEN 'Low Throughput' ELSE 'High Throughput' END AS through
 FROM (SELECT *, l_partkey AS x FROM lines UNION ALL SELECT *, l_partkey + 1 AS x FROM lines WHERE l_linenumber = 7)
 WHERE x <> far AND x IN (SELECT node_id FROM nodes) AND far IN (SELECT node_id FROM nodes)"""),
    "hits_b": (["lines", "nodes"], f"""
 SELECT least(x, y) AS a, greatest(x, y) AS b, 'b' AS source, '' AS system, '' AS kind,
  {nth('l_linenumber', I.METHODS)} AS method,
  CASE l_returnflag WHEN 'R' THEN 'MI:0407' WHEN 'A' THEN 'MI:0915' ELSE 'MI:0914' END AS itype,
  CASE WHEN l_linenumber = 3 THEN [CAST(l_orderkey + 1000000 AS VARCHAR), '15364'] ELSE [CAST(l_orderkey + 1000000 AS VARCHAR)] END AS pubs,
  '' AS through
 FROM (SELECT *, l_partkey AS x, l_partkey + l_linenumber * 7 AS y FROM lines WHERE tax = 0)
 WHERE x IN (SELECT node_id FROM nodes) AND y IN (SELECT node_id FROM nodes)"""),
    "hits": (["hits_a", "hits_b"], "SELECT * FROM hits_a UNION ALL SELECT * FROM hits_b"),
    "evidence": (["hits"], """
 SELECT h.a, h.b, bool_or(kind = 'physical') AS phys, bool_or(kind = 'genetic') AS gen, bool_or(source = 'b') AS cb,
  bool_or(system IN ('Two-hybrid','PCA','FRET') OR method IN ('MI:0018','MI:0397','MI:0096') OR itype = 'MI:0407') AS tier1,
  coalesce(string_agg(DISTINCT nullif(system,''), ';' ORDER BY nullif(system,'')), '') AS assays,
  coalesce(string_agg(DISTINCT nullif(method,''), ';' ORDER BY nullif(method,'')), '') AS methods,
  coalesce(string_agg(DISTINCT nullif(itype,''), ';' ORDER BY nullif(itype,'')), '') AS itypes,
  coalesce(string_agg(DISTINCT nullif(through,''), ';' ORDER BY nullif(through,'')), '') AS throughput,
  any_value(p.n) AS n_pub, any_value(p.t) AS pubs
 FROM hits h JOIN (SELECT a, b, count(*) AS n, string_agg(id, ';' ORDER BY CAST(id AS BIGINT)) AS t
  FROM (SELECT DISTINCT a, b, unnest(pubs) AS id FROM hits) GROUP BY 1, 2) p ON p.a = h.a AND p.b = h.b
 GROUP BY h.a, h.b"""),
    "physical": (["evidence", "nodes"], """
 SELECT e.*, x.group_id FROM evidence e JOIN nodes x ON x.node_id = e.a JOIN nodes y ON y.node_id = e.b
 WHERE x.group_id = y.group_id AND (phys OR cb)"""),
    "places": ([], f"""
 SELECT p_partkey AS node_id, {buckets('loc', 'comp')} AS bk FROM (
  SELECT p_partkey, {case("split_part(p_name,' ',2)", I.NOUN_LOCATIONS)} AS loc, {case('p_type', I.TYPE_COMPONENTS)} AS comp FROM part)"""),
    "vecs": ([], """
 SELECT p_partkey AS node_id, embedding AS v FROM part JOIN embeddings
  ON p_partkey % (SELECT count(*) FROM embeddings) = vec_id"""),
    "cand": (["nodes"], f"""
 SELECT x.group_id, x.group_name, x.node_id AS a, y.node_id AS b, x.name AS na, y.name AS nb, x.role AS ra, y.role AS rb,
  x.accession AS aa, y.accession AS ab
 FROM nodes x JOIN nodes y ON x.group_id = y.group_id AND x.node_id < y.node_id WHERE {is_pair('x.role', 'y.role')}"""),
    "shared": (["cand", "adj"], """
 SELECT a, b, count(*) AS shared FROM cand JOIN adj p ON p.u = a JOIN adj q ON q.u = b AND q.v = p.v GROUP BY 1, 2"""),
    "scores": (["cand", "vecs"], """
 SELECT c.a, c.b, c.group_id,
  round(1.0 / (1.0 + exp(-list_dot_product(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[])))), 9) AS p
 FROM cand c JOIN vecs x ON x.node_id = c.a JOIN vecs y ON y.node_id = c.b"""),
    "graded0": (["cand", "deg", "places", "evidence", "channels", "context", "shared", "scores"], f"""
 SELECT c.*, da.degree AS dega, db.degree AS degb, da.degree * db.degree AS dp, coalesce(s.shared, 0) AS shared, sc.p,
  k.a IS NOT NULL AS known, coalesce(ch.combined, 0.0) AS comb0, coalesce(ch.dominant_channel, '') AS dom,
  coalesce(e.phys, false) AS phys, coalesce(e.gen, false) AS gen, coalesce(e.cb, false) AS cb,
  coalesce(e.n_pub, 0) AS n_pub, coalesce(e.assays, '') AS assays, coalesce(e.methods, '') AS methods,
  coalesce(e.pubs, '') AS pubs, coalesce(e.throughput, '') AS throughput,
  pa.bk AS bka, pb.bk AS bkb, {overlap('pa.bk', 'pb.bk')} AS ov,
  quantile_cont(da.degree * db.degree, 0.9) OVER () AS cutoff
 FROM cand c JOIN deg da ON da.node_id = c.a JOIN deg db ON db.node_id = c.b
 JOIN places pa ON pa.node_id = c.a JOIN places pb ON pb.node_id = c.b
 LEFT JOIN evidence e ON e.a = c.a AND e.b = c.b LEFT JOIN channels ch ON ch.a = c.a AND ch.b = c.b
 LEFT JOIN context k ON k.a = c.a AND k.b = c.b LEFT JOIN shared s ON s.a = c.a AND s.b = c.b
 LEFT JOIN scores sc ON sc.a = c.a AND sc.b = c.b"""),
    "graded": (["graded0"], """
 SELECT *, NOT in_graph AS absent, gen AND NOT phys AND NOT cb AS gen_only,
  CASE WHEN phys OR cb THEN 'physical_curated'
   WHEN ov = 'conflicting' OR (comb >= 0.7 AND dom = 'textmining') OR dp >= cutoff THEN 'artifact_risk'
   WHEN comb >= 0.7 THEN 'string_functional_only' ELSE 'unreported' END AS cls
 FROM (SELECT *, known OR comb >= 0.7 AS in_graph FROM (
  SELECT *, CASE WHEN known AND comb0 < 0.7 THEN 0.7 ELSE comb0 END AS comb FROM graded0))"""),
    "node_index": (["nodes"], """
 SELECT node_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY md5(concat_ws('|','node',node_id)), node_id) - 1 AS idx
 FROM nodes"""),
    "forbidden": (["physical"], "SELECT a, b FROM physical"),
    "link_pos": (["context"], f"""
 SELECT seed, {part('n', 'rk', K.EDGE_RATIOS, 'floor')} AS split, a, b, group_id FROM (
  SELECT seed, a, b, group_id, count(*) OVER (PARTITION BY seed, group_id) AS n,
   row_number() OVER (PARTITION BY seed, group_id ORDER BY md5(concat_ws('|','group',seed,a,b)), a, b) AS rk
  FROM context, {SEEDS20})"""),
    "random_pos": (["physical"], f"""
 SELECT protocol, seed, {part('n', 'rk', K.EDGE_RATIOS, 'round')} AS split, a, b, group_id FROM (
  SELECT protocol, seed, a, b, group_id, count(*) OVER (PARTITION BY protocol, seed) AS n,
   row_number() OVER (PARTITION BY protocol, seed ORDER BY md5(concat_ws('|',protocol,seed,a,b)), a, b) AS rk
  FROM physical, {SEEDS20}, (VALUES ('edge_random'), ('degree_matched')) t(protocol))"""),
    "node_part": (["nodes"], f"""
 SELECT seed, node_id, {part('n', 'rk', K.NODE_RATIOS, 'round')} AS part FROM (
  SELECT seed, node_id, count(*) OVER (PARTITION BY seed, group_id) AS n,
   row_number() OVER (PARTITION BY seed, group_id ORDER BY md5(concat_ws('|','node_disjoint',seed,node_id)), node_id) AS rk
  FROM nodes, {SEEDS20})"""),
    "disjoint_pos": (["physical", "node_part"], """
 SELECT 'node_disjoint' AS protocol, x.seed, x.part AS split, p.a, p.b, p.group_id FROM physical p
 JOIN node_part x ON x.node_id = p.a JOIN node_part y ON y.node_id = p.b AND y.seed = x.seed AND y.part = x.part"""),
    "pos": (["random_pos", "disjoint_pos"], "SELECT * FROM random_pos UNION ALL SELECT * FROM disjoint_pos"),
    "wanted": (["pos"], f"SELECT {', '.join(PK)}, group_id, count(*) AS n FROM pos GROUP BY ALL"),
    "pool": (["pos", "node_index", "forbidden", "nodes"], draws_sql("pos", PK, 4)),
    "run_deg": (["pos", "context", "nodes"], """
 SELECT r.protocol, r.seed, n.node_id, coalesce(d.d, 0) - coalesce(t.r, 0) AS degree
 FROM (SELECT DISTINCT protocol, seed FROM pos) r CROSS JOIN nodes n
 LEFT JOIN (SELECT u, count(*) AS d FROM (SELECT a AS u FROM context UNION ALL SELECT b FROM context) GROUP BY 1) d ON d.u = n.node_id
 LEFT JOIN (SELECT protocol, seed, u, count(*) AS r FROM (
   SELECT protocol, seed, unnest([p.a, p.b]) AS u FROM (SELECT DISTINCT protocol, seed, a, b FROM pos WHERE split <> 'train') p
   SEMI JOIN context c ON c.a = p.a AND c.b = p.b) GROUP BY ALL) t
  ON t.protocol = r.protocol AND t.seed = r.seed AND t.u = n.node_id"""),
    "neg_uniform": (["pool", "wanted"], take_sql("(SELECT * FROM pool WHERE protocol <> 'degree_matched')", "wanted", PK)),
    "measured": (["pos", "pool", "run_deg"], f"""
 SELECT q.*, CAST(x.degree * y.degree AS BIGINT) AS product, floor(ln(CAST(x.degree * y.degree AS DOUBLE) + 1.0) / {TOLERANCE}) AS band,
  md5(concat_ws('|', {', '.join('q.' + c for c in PK)}, q.a, q.b)) AS h FROM (
   SELECT 'slot' AS src, {', '.join(PK)}, group_id, a, b FROM pos WHERE protocol = 'degree_matched'
   UNION ALL SELECT 'pool', {', '.join(PK)}, group_id, a, b FROM pool WHERE protocol = 'degree_matched') q
  JOIN run_deg x ON x.protocol = q.protocol AND x.seed = q.seed AND x.node_id = q.a
  JOIN run_deg y ON y.protocol = q.protocol AND y.seed = q.seed AND y.node_id = q.b"""),
    **cells_sql("equal", "measured", "product"),
    **cells_sql("band", "equal_left", "band"),
    **border_sql("even", "band_left", 0),
    **border_sql("odd", "even_left", 1),
    "matched": (["equal_found", "band_found", "even_found", "odd_found"], " UNION ALL ".join(
        f"SELECT *, '{step}' AS step FROM {name}_found" for name, step in (("equal", "equal"), ("band", "band"), ("even", "border"), ("odd", "border")))),
    "missing": (["odd_left"], f"SELECT {OWN}, count(*) AS n FROM odd_left WHERE src = 'slot' GROUP BY ALL"),
    "near": (["odd_left"], f"""
 SELECT p.* EXCLUDE (src), min(abs(p.band - d.band)) AS far FROM (SELECT DISTINCT src, {OWN}, band FROM odd_left) p
 JOIN (SELECT DISTINCT {OWN}, band FROM odd_left WHERE src = 'slot') d ON p.src = 'pool' AND {same('p', 'd')} GROUP BY ALL"""),
    "spare": (["odd_left", "near"], f"""
 SELECT p.* EXCLUDE (src, product, h), n.far FROM odd_left p JOIN near n ON p.src = 'pool' AND n.band = p.band AND {same('p', 'n')}"""),
    "neg_matched": (["matched", "spare", "missing"], f"SELECT {', '.join(PK)}, a, b, group_id FROM matched UNION ALL SELECT * FROM ("
                    + take_sql("spare", "missing", PK, "far, ") + ")"),
    "split": (["pos", "neg_uniform", "neg_matched"], f"""
 SELECT {', '.join(PK)}, 1 AS label, a, b, group_id FROM pos
 UNION ALL SELECT {', '.join(PK)}, 0, a, b, group_id FROM neg_uniform
 UNION ALL SELECT {', '.join(PK)}, 0, a, b, group_id FROM neg_matched"""),
    "touched": (["pos"], """
 SELECT DISTINCT seed, unnest([a, b]) AS node_id FROM pos WHERE protocol = 'node_disjoint' AND split = 'train'"""),
    "run_ctx": (["pos", "context", "touched"], """
 SELECT r.protocol, r.seed, c.a, c.b FROM (SELECT DISTINCT protocol, seed FROM pos) r CROSS JOIN context c
 WHERE NOT EXISTS (SELECT 1 FROM pos h WHERE h.split <> 'train' AND h.protocol = r.protocol AND h.seed = r.seed AND h.a = c.a AND h.b = c.b)
  AND (r.protocol <> 'node_disjoint' OR (
   EXISTS (SELECT 1 FROM touched t WHERE t.seed = r.seed AND t.node_id = c.a) AND
   EXISTS (SELECT 1 FROM touched t WHERE t.seed = r.seed AND t.node_id = c.b)))"""),
    "run_adj": (["run_ctx"], """
 SELECT protocol, seed, a AS u, b AS v FROM run_ctx UNION ALL SELECT protocol, seed, b, a FROM run_ctx"""),
    "run_degree": (["run_adj"], "SELECT protocol, seed, u, count(*) AS d FROM run_adj GROUP BY ALL"),
    "test_pairs": (["split"], "SELECT DISTINCT protocol, seed, a, b, label FROM split WHERE split = 'test'"),
    "test_distinct": (["test_pairs"], "SELECT DISTINCT protocol, seed, a, b FROM test_pairs"),
    "run_shared": (["test_distinct", "run_adj", "run_degree"], """
 SELECT t.protocol, t.seed, t.a, t.b, count(*) AS shared, round(sum(CASE WHEN d.d > 1 THEN 1.0 / ln(d.d) ELSE 0 END), 10) AS aa
 FROM test_distinct t JOIN run_adj p ON p.protocol = t.protocol AND p.seed = t.seed AND p.u = t.a
 JOIN run_adj q ON q.protocol = t.protocol AND q.seed = t.seed AND q.u = t.b AND q.v = p.v
 JOIN run_degree d ON d.protocol = t.protocol AND d.seed = t.seed AND d.u = p.v GROUP BY ALL"""),
    "run_l3": (["test_distinct", "run_adj"], """
 SELECT t.protocol, t.seed, t.a, t.b, count(*) AS l3
 FROM test_distinct t JOIN run_adj p ON p.protocol = t.protocol AND p.seed = t.seed AND p.u = t.a
 JOIN run_adj m ON m.protocol = t.protocol AND m.seed = t.seed AND m.u = p.v
 JOIN run_adj q ON q.protocol = t.protocol AND q.seed = t.seed AND q.u = m.v AND q.v = t.b GROUP BY ALL"""),
    "model_scores": (["test_pairs", "run_shared", "run_l3", "run_degree"], """
 SELECT protocol, seed, a, b, label, unnest(['jaccard','adamic_adar','preferential_attachment','l3']) AS model,
  unnest([CASE WHEN da + db - sh > 0 THEN sh / (da + db - sh) ELSE 0.0 END, aa, CAST(da * db AS DOUBLE), CAST(l3 AS DOUBLE)]) AS score
 FROM (SELECT t.*, coalesce(x.d, 0) AS da, coalesce(y.d, 0) AS db, coalesce(s.shared, 0) AS sh, coalesce(s.aa, 0.0) AS aa,
   coalesce(l.l3, 0) AS l3 FROM test_pairs t
  LEFT JOIN run_degree x ON x.protocol = t.protocol AND x.seed = t.seed AND x.u = t.a
  LEFT JOIN run_degree y ON y.protocol = t.protocol AND y.seed = t.seed AND y.u = t.b
  LEFT JOIN run_shared s ON s.protocol = t.protocol AND s.seed = t.seed AND s.a = t.a AND s.b = t.b
  LEFT JOIN run_l3 l ON l.protocol = t.protocol AND l.seed = t.seed AND l.a = t.a AND l.b = t.b)"""),
}


def metric_ctes(source: str, keys: list[str]) -> str:
    """AUROC, AP and precision CTEs over ``source`` (keys, a, b, label, score) ending in ``metrics``."""
    k = ", ".join(keys)
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in keys)     # noqa: E731
    return f"""hist AS (SELECT {k}, score, sum(label) AS p, sum(1 - label) AS n FROM {source} GROUP BY {k}, score),
cum AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY {k}) AS tp, sum(n) OVER (PARTITION BY {k}) AS tn
 FROM hist WINDOW w AS (PARTITION BY {k} ORDER BY score DESC)),
curve AS (SELECT {k},
 CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN sum(CAST(n AS DOUBLE) * (cp - p + p / 2.0)) / (CAST(max(tp) AS DOUBLE) * max(tn)) END AS auroc,
 CASE WHEN max(tp) > 0 AND max(tn) > 0 THEN sum(CAST(p AS DOUBLE) * cp / (cp + cn)) / max(tp) END AS ap FROM cum GROUP BY {k}),
best AS (SELECT {k}, label, row_number() OVER (PARTITION BY {k} ORDER BY score DESC, label DESC, a, b) AS r FROM {source}),
prec AS (SELECT {k}, avg(label) FILTER (r <= 10) AS p_at_10, avg(label) FILTER (r <= 20) AS p_at_20, avg(label) FILTER (r <= 50) AS p_at_50
 FROM best GROUP BY {k}),
metrics AS (SELECT {', '.join('c.' + x for x in keys)}, auroc, ap,
 CASE WHEN auroc IS NOT NULL THEN p_at_10 END AS p_at_10, CASE WHEN auroc IS NOT NULL THEN p_at_20 END AS p_at_20,
 CASE WHEN auroc IS NOT NULL THEN p_at_50 END AS p_at_50 FROM curve c JOIN prec q ON {on('c', 'q')})"""


def sql(needs: list[str], body: str, more: str = "") -> str:
    """WITH the needed CTEs (and ``more`` literal ones) in dependency order, then the body."""
    order: list[str] = []

    def visit(name):
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)
    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order] + ([more] if more else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
