"""DuckDB SQL that answers the registered queries on the same tables.

Every statement is built from shared common table expressions: ``dims`` (grid
size), ``cells`` (id, r, c, h, v; id is row-major), ``nb`` (cell and neighbour
pairs) and so on.  All of them read whole tables.
"""

from __future__ import annotations

ID = "CAST(({0} // w) * 4294967296 + {0} % w AS BIGINT)"  # packed (row, col)
RC = 'CAST(r AS INT) AS "row", CAST(c AS INT) AS "col"'

DIMS = """
dims AS (SELECT w, n, (n + w - 1) // w AS nr FROM
  (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w, count(*) AS n FROM orders)),
grid AS (SELECT k AS id, k // w AS r, k % w AS c FROM dims, unnest(range(0, w * nr)) AS t(k)),
steps(i, dr, dc, len) AS (VALUES (0,-1,0,1.0),(1,-1,1,sqrt(2)),(2,0,1,1.0),(3,1,1,sqrt(2)),
  (4,1,0,1.0),(5,1,-1,sqrt(2)),(6,0,-1,1.0),(7,-1,-1,sqrt(2)))"""

HEIGHTS = {
    "orders": "SELECT o_orderkey AS k, CAST(floor(o_totalprice / 2000) AS INT) AS h FROM orders",
    "blocks": """SELECT o_orderkey AS k, p_size AS h FROM dims, orders, part, (SELECT count(*) AS np FROM part)
      WHERE p_partkey = ((o_orderkey // w // 3) * CAST(ceil(w / 3.0) AS BIGINT) + (o_orderkey % w) // 3) % np""",
    "valley": """SELECT o_orderkey AS k, CAST(least(255, abs(o_orderkey // w - w // 2) * 3 + (w - 1 - o_orderkey % w) * 2
      + ((o_orderkey // w) * 31 + (o_orderkey % w) * 17) % 5) AS INT) AS h FROM orders, dims""",
    "arrows": "SELECT o_orderkey AS k, CAST((o_custkey % 9) - 1 AS INT) AS h FROM orders",
}


def raster(name: str, masked: bool = False) -> str:
    """``cells`` of a raster; ``masked`` also clears ``v`` where the event mask does."""
    keep = " AND coalesce(e.event_id % 11 <> 0, true)" if masked else ""
    join = "LEFT JOIN events e ON e.event_id = g.id" if masked else ""
    return DIMS + f""",
src AS MATERIALIZED ({HEIGHTS[name]}),
cells AS MATERIALIZED (SELECT g.id, g.r, g.c, coalesce(s.h, 0) AS h, s.k IS NOT NULL{keep} AS v
  FROM grid g LEFT JOIN src s ON s.k = g.id {join})"""


NB = """,
reach AS MATERIALIZED (SELECT a.id, a.r, a.c, a.h, a.v, s.i, s.len,
  CASE WHEN a.c + s.dc BETWEEN 0 AND w - 1 THEN a.id + s.dr * w + s.dc END AS k FROM cells a, steps s, dims),
nb AS MATERIALIZED (SELECT a.id, a.r, a.c, a.h, a.v, a.i, a.len, b.id AS nid, b.h AS nh, b.v AS nv
  FROM reach a LEFT JOIN cells b ON b.id = a.k)"""
EDGE = """,
contact AS MATERIALIZED (SELECT id, v AND bool_or(NOT coalesce(nv, false)) AS e FROM nb GROUP BY id, v)"""
STRICT = """,
strict AS MATERIALIZED (SELECT c.id, c.r, c.c, c.v, coalesce(d.i, -1) AS d FROM cells c LEFT JOIN
  (SELECT id, arg_min(i, [-(h - nh) / len, i]) AS i FROM nb WHERE v AND nv AND h > nh GROUP BY id) d ON d.id = c.id)"""
ARROWS = """,
strict AS MATERIALIZED (SELECT id, r, c, v, CASE WHEN v THEN h ELSE -1 END AS d FROM cells)"""
FLOW = """,
flow AS MATERIALIZED (SELECT s.id AS src, t.id AS dst FROM strict s JOIN steps k ON k.i = s.d
  JOIN cells t ON t.r = s.r + k.dr AND t.c = s.c + k.dc)"""
WALK = """,
walk(src, cur, n) AS (SELECT id, id, 0 FROM cells UNION ALL
  SELECT w.src, f.dst, w.n + 1 FROM walk w JOIN flow f ON f.src = w.cur)"""
ACC = """,
acc AS MATERIALIZED (SELECT cur AS id, count(*) AS a FROM walk GROUP BY cur)"""


def components(name: str, active: str, pairs: str) -> str:
    """Smallest-id labelling ``name(id, lab)`` of the ids in ``active`` along ``pairs``."""
    return f""",
{name}_on AS MATERIALIZED ({active}),
{name}_pair AS MATERIALIZED ({pairs}),
{name}(id, lab) USING KEY (id) AS (SELECT id, id FROM {name}_on UNION
  SELECT p.b, min(x.lab) FROM {name} x JOIN {name}_pair p ON p.a = x.id
  JOIN recurring.{name} AS y ON y.id = p.b GROUP BY p.b, y.lab HAVING min(x.lab) < y.lab)"""


def mask_components(name: str, active: str) -> str:
    return components(
        name, active,
        f"SELECT nb.id AS a, nb.nid AS b FROM nb JOIN {name}_on x ON x.id = nb.id JOIN {name}_on y ON y.id = nb.nid")


FLATS = components("flat", "SELECT id FROM cells WHERE v", "SELECT id AS a, nid AS b FROM nb WHERE v AND nv AND h = nh")
DROPS = """,
drops AS MATERIALIZED (SELECT nb.id, max(CASE WHEN nv AND coalesce(y.lab <> x.lab, true) AND h > nh THEN h - nh ELSE 0 END) AS d
  FROM nb JOIN flat x ON x.id = nb.id LEFT JOIN flat y ON y.id = nb.nid GROUP BY nb.id)"""
OUTLETS = """,
around AS MATERIALIZED (SELECT x.lab, nb.id, nb.h, nb.nh FROM nb JOIN flat x ON x.id = nb.id LEFT JOIN flat y ON y.id = nb.nid
  WHERE nv AND coalesce(y.lab <> x.lab, true)),
region AS (SELECT f.lab, count(*) AS size FROM flat f GROUP BY f.lab),
fo AS MATERIALIZED (SELECT g.lab, g.size, coalesce(bool_or(a.nh < a.h), false) AS has_lower,
  min(CASE WHEN a.nh >= a.h THEN a.nh END) AS spill FROM region g LEFT JOIN around a ON a.lab = g.lab GROUP BY g.lab, g.size),
anchors AS (SELECT fo.lab, min(a.id) AS anchor FROM fo JOIN around a ON a.lab = fo.lab AND a.nh = fo.spill GROUP BY fo.lab)"""
FLOOD = EDGE + """,
lv AS (SELECT DISTINCT h AS l FROM cells WHERE v),
wet(l, id) AS (SELECT l, c.id FROM lv, cells c JOIN contact k ON k.id = c.id WHERE k.e AND c.h <= l
  UNION SELECT wet.l, nb.nid FROM wet JOIN nb ON nb.id = wet.id WHERE nb.nv AND nb.nh <= wet.l),
filled AS MATERIALIZED (SELECT c.id, c.r, c.c, c.h, c.v, coalesce(x.l, c.h) AS f FROM cells c
  LEFT JOIN (SELECT id, min(l) AS l FROM wet GROUP BY id) x ON x.id = c.id)"""
GRAD = """,
grad AS MATERIALIZED (SELECT id, r, c, v, coalesce(max(CASE WHEN v AND nv THEN abs(h - nh) END), 0) AS g FROM nb GROUP BY id, r, c, v),
gs AS MATERIALIZED (SELECT id, r, c, 1 - least(1.0, g / (SELECT CASE WHEN q <= 1e-6 THEN 1.0 ELSE q END
  FROM (SELECT quantile_cont(CAST(g AS DOUBLE), 0.95) AS q FROM grad WHERE v))) AS s FROM grad)"""
VARIANCE = """,
box AS MATERIALIZED (SELECT a.id, a.r, a.c, a.v, sum(CAST(b.h AS DOUBLE)) AS s1, sum(CAST(b.h AS DOUBLE) * b.h) AS s2, count(*) AS m
  FROM cells a JOIN cells b ON b.v AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1
  GROUP BY a.id, a.r, a.c, a.v),
var AS MATERIALIZED (SELECT c.id, c.r, c.c, c.v, CASE WHEN c.v THEN CAST(CAST(greatest(s2 / m - (s1 / m) * (s1 / m), 0) AS FLOAT) AS DOUBLE)
  ELSE 0 END AS g FROM cells c LEFT JOIN box b ON b.id = c.id),
vs AS MATERIALIZED (SELECT id, r, c, 1 - least(1.0, g / (SELECT CASE WHEN q <= 1e-6 THEN 1.0 ELSE q END
  FROM (SELECT quantile_cont(g, 0.95) AS q FROM var WHERE v))) AS s FROM var)"""
BORDER = """,
vals AS (SELECT id, r, c, h FROM cells WHERE v AND r = 0 UNION ALL SELECT id, r, c, h FROM cells, dims WHERE v AND r = nr - 1
  UNION ALL SELECT id, r, c, h FROM cells WHERE v AND c = 0 UNION ALL SELECT id, r, c, h FROM cells, dims WHERE v AND c = w - 1)"""
VALLEY_CHANNEL = STRICT + FLOW + WALK + ACC + """,
chan AS MATERIALIZED (SELECT c.id, c.r, c.c, c.v AND a.a >= 20 AS on_ FROM cells c JOIN acc a ON a.id = c.id)"""
TRIM = EDGE + """,
feed AS (SELECT f.dst AS id, bool_or(NOT k.e) AS inner_ FROM flow f JOIN chan s ON s.id = f.src AND s.on_
  JOIN contact k ON k.id = f.src GROUP BY f.dst),
trimmed AS MATERIALIZED (SELECT c.id, c.r, c.c, c.on_ AND (NOT k.e OR coalesce(f.inner_, true)) AS on_ FROM chan c
  JOIN contact k ON k.id = c.id LEFT JOIN feed f ON f.id = c.id)"""


def sql(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def kept(name: str, source: str, smallest: int) -> str:
    """``name(id, r, c, on_)``: pieces of ``source.on_`` below ``smallest`` cells removed."""
    return mask_components(f"{name}_lab", f"SELECT id FROM {source} WHERE on_") + f""",
{name}_big AS MATERIALIZED (SELECT lab FROM {name}_lab GROUP BY lab HAVING count(*) >= {smallest}),
{name} AS MATERIALIZED (SELECT t.id, t.r, t.c, t.on_ AND b.lab IS NOT NULL AS on_ FROM {source} t
  LEFT JOIN {name}_lab x ON x.id = t.id LEFT JOIN {name}_big b ON b.lab = x.lab)"""




ORACLES: dict[str, str] = {}


def add(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = sql(ctes, select)


O, B, V = raster("orders"), raster("blocks"), raster("valley")
OM, VM = raster("orders", True), raster("valley", True)
D = lambda e: f"round(CAST({e} AS DOUBLE), 6)"

add("cells_from_table", O, f"SELECT {RC}, {D('h')} AS height FROM cells WHERE v")
add("densify", O, f"SELECT {RC}, {D('h')} AS height, v AS valid FROM cells")
add("neighbor_gather", O + NB, f"SELECT {RC}, " + ", ".join(
    f"{D(f'max(CASE WHEN i = {i} THEN nh END)')} AS n{i}" for i in range(8)) + " FROM nb GROUP BY r, c")
add("height_mapping", O, f"SELECT {RC}, {D('255 - h')} AS height FROM cells")
add("valid_mask", O, f"SELECT {RC}, v AND abs(h - 30) > 1e-8 + 1e-5 * 30 AS valid FROM cells")
add("apply_mask", OM, f"SELECT {RC}, v AS valid FROM cells")
add("roi_crop", O + """,
inner_ AS MATERIALIZED (SELECT id, r, c, h, v AND h > 240 AS v FROM cells),
bb AS (SELECT min(r) AS a, max(r) AS b, min(c) AS x, max(c) AS y FROM inner_ WHERE v)""",
    f"SELECT {RC}, {D('h')} AS height, v AS valid FROM inner_, bb, dims WHERE r BETWEEN greatest(0, a - 3) AND least(nr - 1, b + 3) "
    "AND c BETWEEN greatest(0, x - 3) AND least(w - 1, y + 3)")
BLOCKMEAN = """SELECT CAST(r // {s} AS INT) AS "row", CAST(c // {s} AS INT) AS "col",
  round(coalesce(CAST(CAST(sum(CASE WHEN v THEN h END) / nullif(count(*) FILTER (WHERE v), 0) AS FLOAT) AS DOUBLE), 0), 6) AS height,
  bool_or(v) AS valid FROM cells{x} GROUP BY r // {s}, c // {s}"""
add("block_mean", OM, BLOCKMEAN.format(s=4, x=""))
add("analysis_scale", O, "SELECT CAST(nr AS INT) AS n_rows, CAST(w AS INT) AS n_cols, CAST(CASE WHEN greatest(nr, w) <= 1536 THEN 1 "
    "ELSE greatest(2, ceil(greatest(nr, w) / 1536.0)) END AS INT) AS scale FROM dims")
add("upsample_mask", O, f"SELECT {RC}, bool_or(v AND h > 240) OVER (PARTITION BY r // 4, c // 4) AS mask FROM cells")
add("scale_area", "x AS (SELECT DISTINCT p_size AS s FROM part)",
    "SELECT CAST(s AS INT) AS scale, CAST(greatest(1, ceil(2048.0 / (s * s))) AS INT) AS area FROM x")
add("overview", OM, """SELECT CAST(r // s AS INT) AS "row", CAST(c // s AS INT) AS "col",
  round(coalesce(CAST(CAST(sum(CASE WHEN v THEN h END) / nullif(count(*) FILTER (WHERE v), 0) AS FLOAT) AS DOUBLE), 0), 6) AS height,
  bool_or(v) AS valid FROM cells, (SELECT CAST(greatest(1, ceil(greatest(nr, w) / 50.0)) AS BIGINT) AS s FROM dims) GROUP BY r // s, c // s""")
BY_50 = ", (SELECT CAST(greatest(1, ceil(greatest(nr, w) / 50.0)) AS BIGINT) AS s FROM dims)"
PYRAMID = """,
lv AS (SELECT s, unnest(range(0, CAST(ceil(log2(CAST(greatest(nr, w) AS DOUBLE) / s)) AS BIGINT) + 1)) AS k FROM (
  SELECT nr, w, CAST(greatest(1, ceil(greatest(nr, w) / 50.0)) AS BIGINT) AS s FROM dims)),
sized AS (SELECT k, s * CAST(pow(2, k) AS BIGINT) AS z FROM lv)"""
add("pyramid", OM + PYRAMID, """SELECT CAST(k AS INT) AS level, CAST(z AS INT) AS scale, CAST(r // z AS INT) AS "row", CAST(c // z AS INT) AS "col",
  round(coalesce(CAST(CAST(sum(CASE WHEN v THEN h END) / nullif(count(*) FILTER (WHERE v), 0) AS FLOAT) AS DOUBLE), 0), 3) AS height,
  bool_or(v) AS valid FROM cells, sized GROUP BY ALL""")
add("edge_contact", OM + NB + EDGE, f"SELECT {RC}, e AS edge_contact FROM cells JOIN contact USING (id)")
add("border_values", OM + BORDER, f"SELECT {RC}, {D('h')} AS height FROM vals")
add("box_smooth", OM + """,
box AS MATERIALIZED (SELECT a.id, avg(CAST(b.h AS DOUBLE)) AS m FROM cells a JOIN cells b ON b.v AND b.r BETWEEN a.r - 2 AND a.r + 2
  AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.id)""",
    f"SELECT {RC}, round(CAST(CAST(CASE WHEN v THEN m ELSE h END AS FLOAT) AS DOUBLE), 4) AS height FROM cells LEFT JOIN box USING (id)")
add("gradient_score", OM + NB + GRAD, f"SELECT {RC}, round(s, 6) AS gradient_score FROM gs")
add("variance_score", OM + VARIANCE, f"SELECT {RC}, round(s, 5) AS variance_score FROM vs")
add("sink_pass", OM + NB + """,
agg AS (SELECT id, min(nh) FILTER (WHERE nv) AS lo, sum(nh) FILTER (WHERE nv) AS s, count(*) FILTER (WHERE nv) AS m,
  bool_or(nv AND abs(nh - h) <= 1e-8 + 1e-5 * abs(h)) AS lvl FROM nb GROUP BY id),
up AS (SELECT c.*, a.*, c.v AND r > 0 AND c.c > 0 AND r < nr - 1 AND c.c < w - 1 AND h < lo AS sink
  FROM cells c JOIN agg a ON a.id = c.id, dims)""",
    f"SELECT {RC}, round(CAST(CAST(CASE WHEN coalesce(sink, false) THEN CASE WHEN lvl THEN lo ELSE s / m END ELSE h END AS FLOAT) AS DOUBLE), 4) AS height, "
    "coalesce(sink, false) AS lifted FROM up")
add("d8_strict", OM + NB + STRICT, f"SELECT {RC}, CAST(d AS INT) AS direction FROM strict")
add("outlet_drop", B + NB + FLATS + DROPS, f"SELECT {RC}, {D('coalesce(d, 0)')} AS drop_height FROM cells LEFT JOIN drops USING (id)")
FIVES = "SELECT id FROM cells WHERE v AND h % 5 = 0"
add("connected_components", O + NB + mask_components("cc", FIVES) + """,
num AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS k FROM (SELECT DISTINCT lab FROM cc))""",
    f"SELECT {RC}, CAST(k AS BIGINT) AS component FROM cells JOIN cc USING (id) JOIN num USING (lab)")
add("component_sizes", O + NB + mask_components("cc", FIVES),
    "SELECT CAST(size AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS components FROM (SELECT lab, count(*) AS size FROM cc GROUP BY lab) GROUP BY size")
add("flat_regions", B + NB + FLATS, f"SELECT {RC}, {ID.format('lab')} AS label FROM cells JOIN flat USING (id), dims")
add("border_connected", O + NB + """,
act AS MATERIALIZED (SELECT id, r, c FROM cells WHERE v AND h % 3 = 0),
hit(id) AS (SELECT id FROM act, dims WHERE r = 0 OR c = 0 OR r = nr - 1 OR c = w - 1 UNION
  SELECT nb.nid FROM hit JOIN nb ON nb.id = hit.id JOIN act ON act.id = nb.nid)""",
    f"SELECT {RC}, hit.id IS NOT NULL AS connected FROM cells LEFT JOIN hit USING (id)")
add("filter_components", O + NB + """,
start_ AS MATERIALIZED (SELECT id, r, c, v AND h % 5 = 0 AS on_ FROM cells)""" + kept("res", "start_", 4),
    f"SELECT {RC}, on_ AS fives FROM res")
add("flat_outlets", B + NB + FLATS + OUTLETS,
    f"SELECT {ID.format('lab')} AS label, CAST(size AS BIGINT) AS size, has_lower, {D('spill')} AS spill, "
    f"{ID.format('anchor')} AS anchor FROM fo LEFT JOIN anchors USING (lab), dims")
add("repair_closed_flats", B + NB + FLATS + OUTLETS + """,
closed AS (SELECT fo.lab, spill, anchor FROM fo JOIN anchors USING (lab) WHERE size > 1 AND NOT has_lower),
bfs(id, lab, d) USING KEY (id) AS (SELECT anchor, lab, 0 FROM closed UNION
  SELECT f.id, b.lab, min(b.d + 1) FROM bfs b JOIN nb ON nb.id = b.id JOIN flat f ON f.id = nb.nid AND f.lab = b.lab
  LEFT JOIN recurring.bfs AS o ON o.id = f.id WHERE o.id IS NULL GROUP BY f.id, b.lab)""",
    f"SELECT {RC}, round(CAST(CAST(CASE WHEN d IS NULL THEN h ELSE spill + 0.0010000000474974513 * (d + 1) END AS FLOAT) AS DOUBLE), 4) AS height, "
    "d IS NOT NULL AS repaired FROM cells LEFT JOIN bfs USING (id) LEFT JOIN closed USING (lab)")
SEGMENTS = components(
    "seg", "SELECT id FROM drops WHERE d > 0",
    "SELECT nb.id AS a, nb.nid AS b FROM nb JOIN drops x ON x.id = nb.id AND x.d > 0 JOIN drops y ON y.id = nb.nid AND y.d > 0 "
    "JOIN flat f ON f.id = nb.id JOIN flat g ON g.id = nb.nid AND g.lab = f.lab")
add("outlet_segments", B + NB + FLATS + DROPS + SEGMENTS + """,
st AS (SELECT f.lab, s.lab AS seg, avg(CAST(d AS DOUBLE)) + 0.35 * ln(1 + count(*)) AS strength, avg(r) AS cr, avg(c) AS cc, count(*) AS n
  FROM seg s JOIN flat f ON f.id = s.id JOIN drops ON drops.id = s.id JOIN cells ON cells.id = s.id GROUP BY f.lab, s.lab)""",
    f"SELECT {ID.format('lab')} AS label, CAST(row_number() OVER (PARTITION BY lab ORDER BY seg) - 1 AS INT) AS segment, "
    "round(strength, 6) AS strength, round(cr, 6) AS center_row, round(cc, 6) AS center_col, CAST(st.n AS BIGINT) AS n_cells FROM st, dims")
ASSIGNED = FLATS + DROPS + SEGMENTS + """,
st AS MATERIALIZED (SELECT s.lab AS seg, avg(CAST(d AS DOUBLE)) + 0.35 * ln(1 + count(*)) AS strength, avg(r) AS cr, avg(c) AS cc
  FROM seg s JOIN drops ON drops.id = s.id JOIN cells ON cells.id = s.id GROUP BY s.lab),
same AS MATERIALIZED (SELECT nb.id AS a, nb.nid AS b FROM nb JOIN flat f ON f.id = nb.id JOIN flat g ON g.id = nb.nid AND g.lab = f.lab),
far(seg, id, d) USING KEY (seg, id) AS (SELECT lab, id, 0 FROM seg UNION
  SELECT x.seg, same.b, min(x.d) + 1 FROM far x JOIN same ON same.a = x.id
  LEFT JOIN recurring.far AS o ON o.seg = x.seg AND o.id = same.b WHERE o.id IS NULL GROUP BY x.seg, same.b),
best AS MATERIALIZED (SELECT far.id, arg_min(struct_pack(seg := far.seg, d := d, strength := strength, cr := cr, cc := cc),
  [CAST(round(strength * -1500000.0) AS BIGINT) + d * 1000000, far.seg]) AS b FROM far JOIN st ON st.seg = far.seg GROUP BY far.id)"""
add("assign_segments", B + NB + ASSIGNED,
    f"SELECT {RC}, {ID.format('flat.lab')} AS label, {ID.format('b.seg')} AS seg_of, CAST(b.d AS INT) AS dist, round(b.strength, 6) AS strength "
    "FROM cells JOIN flat USING (id) LEFT JOIN best USING (id), dims")


def flat_choice(texture: str) -> str:
    """``choice(id, i)``: the best scored neighbour of the same segment that is nearer to it."""
    scaled = lambda x: f"CASE WHEN top_{x} > 0 THEN CAST(CAST({x} AS DOUBLE) / CAST(top_{x} AS DOUBLE) AS FLOAT) ELSE CAST(0 AS FLOAT) END"
    weight = lambda w: f"CAST({w} AS FLOAT)"
    return ASSIGNED + f""",
score AS MATERIALIZED (SELECT nb.id, nb.i, {texture} AS tex,
  CAST((x.b.d - y.b.d) / CAST(greatest(x.b.d, 1) AS DOUBLE) AS FLOAT) AS esc, CAST(x.b.strength / (1.0::DOUBLE + y.b.d) AS FLOAT) AS prox,
  CAST(CASE WHEN gl > 0 THEN greatest(0.0, (dr * gr + dc * gc) / (sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) * gl)) ELSE 0.0 END AS FLOAT) AS cont
  FROM nb JOIN best x ON x.id = nb.id JOIN best y ON y.id = nb.nid AND y.b.seg = x.b.seg AND y.b.d < x.b.d JOIN steps k ON k.i = nb.i
  JOIN (SELECT id, b.cr - r AS gr, b.cc - c AS gc, sqrt((b.cr - r) * (b.cr - r) + (b.cc - c) * (b.cc - c)) AS gl FROM best JOIN cells USING (id)) goal ON goal.id = nb.id),
tops AS (SELECT id, max(tex) AS top_tex, max(prox) AS top_prox, max(cont) AS top_cont FROM score GROUP BY id),
total AS (SELECT id, i, CAST(CAST(CAST(CAST({scaled("tex")} * {weight(1.0)} AS FLOAT) + esc * {weight(0.6)} AS FLOAT)
  + {scaled("prox")} * {weight(0.4)} AS FLOAT) + {scaled("cont")} * {weight(0.3)} AS FLOAT) AS t FROM score JOIN tops USING (id)),
choice AS MATERIALIZED (SELECT id, arg_min(i, [-t, i]) AS i FROM total WHERE t > 0 GROUP BY id)"""


add("flat_directions", B + NB + flat_choice("CAST(greatest(0.0, nb.h - nb.nh) AS FLOAT)"),
    f"SELECT {RC}, CAST(coalesce(i, -1) AS INT) AS flat_direction FROM cells LEFT JOIN choice USING (id)")
add("resolve_flats", B + NB + STRICT + flat_choice("CAST(0 AS FLOAT)"),
    f"SELECT {RC}, CAST(CASE WHEN d = -1 THEN coalesce(i, -1) ELSE d END AS INT) AS direction FROM strict LEFT JOIN choice USING (id)")
EXITS = STRICT + flat_choice("CAST(0 AS FLOAT)") + """,
dirs AS MATERIALIZED (SELECT s.id, s.v, CASE WHEN d = -1 THEN coalesce(i, -1) ELSE d END AS d FROM strict s LEFT JOIN choice USING (id))""" + mask_components(
    "un", "SELECT id FROM dirs WHERE v AND d < 0") + """,
flow AS MATERIALIZED (SELECT s.id AS src, nb.nid AS dst FROM dirs s JOIN nb ON nb.id = s.id AND nb.i = s.d WHERE nb.nid IS NOT NULL)""" + WALK + """,
ends AS MATERIALIZED (SELECT e.src AS id, u.lab AS catch, e.n AS hops FROM (SELECT src, arg_max(cur, n) AS cur, max(n) AS n FROM walk GROUP BY src) e
  LEFT JOIN un u ON u.id = e.cur),
ways AS MATERIALIZED (SELECT x.catch, nb.id, nb.r, nb.c, nb.i, x.hops, CASE WHEN coalesce(nv, false) THEN y.catch END AS nxt,
  CASE WHEN coalesce(nv, false) THEN CASE WHEN x.hops = 0 THEN 0 ELSE 2 END ELSE CASE WHEN x.hops = 0 THEN 1 ELSE 3 END END AS cls,
  coalesce(nv, false) AS near, CAST(nh - h AS DOUBLE) AS rise, nh FROM nb JOIN ends x ON x.id = nb.id LEFT JOIN ends y ON y.id = nb.nid
  WHERE nb.v AND x.catch IS NOT NULL AND (NOT coalesce(nv, false) OR y.catch IS DISTINCT FROM x.catch)),
pick AS MATERIALIZED (SELECT catch, arg_min(struct_pack(id := id, r := r, c := c, i := i, nxt := nxt, reach := CASE WHEN cls = 3 THEN 4611686018427387904 ELSE
  CASE WHEN cls = 2 THEN hops ELSE 0 END END), [CAST(cls AS DOUBLE), CASE WHEN near THEN hops ELSE 0 END, CASE WHEN near THEN rise ELSE 0 END,
  CASE WHEN near THEN nh ELSE 0 END, r, c, i, coalesce(nxt, -1)]) AS p FROM ways GROUP BY catch)"""
add("component_exit", B + NB + EXITS, f"""SELECT {ID.format('catch')} AS catch, CAST(p.r AS INT) AS "row", CAST(p.c AS INT) AS "col", CAST(p.i AS INT) AS dir,
  CAST(p.reach AS BIGINT) AS reach, CASE WHEN p.nxt IS NOT NULL THEN {ID.format('p.nxt')} END AS nxt FROM pick, dims""")
add("route_components", B + NB + EXITS + """,
held AS MATERIALIZED (SELECT e.id, e.catch, p.p.id AS anchor, p.p.i AS dir FROM ends e JOIN pick p ON p.catch = e.catch WHERE e.hops <= p.p.reach),
bfs(id, catch, d) USING KEY (id) AS (SELECT id, catch, 0 FROM held WHERE id = anchor UNION
  SELECT f.id, b.catch, min(b.d + 1) FROM bfs b JOIN nb ON nb.id = b.id JOIN held f ON f.id = nb.nid AND f.catch = b.catch
  LEFT JOIN recurring.bfs AS o ON o.id = f.id WHERE o.id IS NULL GROUP BY f.id, b.catch),
turn AS (SELECT nb.id, arg_min(nb.i, [CAST(nb.nh - nb.h AS DOUBLE), nb.i]) AS i FROM nb JOIN bfs x ON x.id = nb.id
  JOIN bfs y ON y.id = nb.nid AND y.catch = x.catch AND y.d < x.d GROUP BY nb.id)""",
    f"SELECT {RC}, CAST(CASE WHEN held.id = anchor THEN dir ELSE turn.i END AS INT) AS routed FROM held JOIN cells USING (id) LEFT JOIN turn USING (id)")
add("preprocess", OM.replace("cells AS MATERIALIZED", "cells0 AS MATERIALIZED") + """,
sm AS (SELECT a.id, avg(CAST(b.h AS DOUBLE)) AS m FROM cells0 a JOIN cells0 b ON b.v AND b.r BETWEEN a.r - 1 AND a.r + 1
  AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.id),
cells AS MATERIALIZED (SELECT id, r, c, CASE WHEN v THEN CAST(CAST(m AS FLOAT) AS DOUBLE) ELSE h END AS h, v FROM cells0 LEFT JOIN sm USING (id))"""
    + NB + EDGE + """,
wet(id, l) USING KEY (id) AS (SELECT c.id, CASE WHEN e THEN c.h ELSE 1e9 END FROM cells c JOIN contact USING (id) WHERE c.v UNION
  SELECT nb.nid, min(greatest(x.l, nb.nh)) FROM wet x JOIN nb ON nb.id = x.id AND nb.nv JOIN recurring.wet AS y ON y.id = nb.nid
  GROUP BY nb.nid, y.l HAVING min(greatest(x.l, nb.nh)) < y.l)""",
    f"SELECT {RC}, round(coalesce(l, h), 4) AS height, v AS valid, round(h, 4) AS texture_height, "
    "round(CAST(CAST(CASE WHEN v THEN l - h ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS fill_depth FROM cells LEFT JOIN wet USING (id)")
add("fill_depressions", B + NB + FLOOD, f"SELECT {RC}, {D('f')} AS height, {D('CASE WHEN v THEN f - h ELSE 0 END')} AS fill_depth FROM filled")
add("fill_depressions_capped", B + NB + FLOOD, f"SELECT {RC}, {D('CASE WHEN v THEN least(f, h + 2) ELSE h END')} AS height FROM filled")
add("fill_audit", B + NB + FLOOD, f"""SELECT CAST(count(*) FILTER (WHERE v AND f > h) AS BIGINT) AS changed,
  {D('max(CASE WHEN v THEN f - h ELSE 0 END)')} AS max_depth, {D('coalesce(avg(f - h) FILTER (WHERE v AND f > h), 0)')} AS mean_depth FROM filled""")
add("fill_policy", DIMS, "SELECT 'priority_flood' AS algorithm, CAST(w * nr AS BIGINT) AS pixels FROM dims")
add("flow_edges", O + NB + STRICT + FLOW, 'SELECT CAST(src // w AS INT) AS "row", CAST(src % w AS INT) AS "col", '
    "CAST(dst // w AS INT) AS dst_row, CAST(dst % w AS INT) AS dst_col FROM flow, dims")
add("flow_terminal", V + NB + STRICT + FLOW + WALK, f"""SELECT {RC}, {ID.format('e.cur')} AS terminal, CAST(e.n AS BIGINT) AS hops
  FROM cells JOIN (SELECT src, arg_max(cur, n) AS cur, max(n) AS n FROM walk GROUP BY src) e ON e.src = cells.id, dims""")
add("unresolved_components", B + NB + STRICT + mask_components("un", "SELECT id FROM strict WHERE v AND d < 0"),
    f"SELECT {RC}, {ID.format('lab')} AS comp FROM cells JOIN un USING (id), dims")
A = raster("arrows")
# A cell is on a cycle iff it is an image after at least as many steps as there are cells.
LOOPS = ARROWS + FLOW + """,
w1 AS (SELECT s.id AS src, coalesce(f.dst, -1) AS cur FROM strict s LEFT JOIN flow f ON f.src = s.id),
"""
for k in range(1, 18):
    LOOPS += f"w{k + 1} AS MATERIALIZED (SELECT a.src, coalesce(b.cur, -1) AS cur FROM w{k} a LEFT JOIN w{k} b ON b.src = a.cur),\n"
LOOPS += "stuck AS (SELECT src AS id, cur FROM w18 WHERE cur >= 0), ring AS (SELECT DISTINCT cur AS id FROM stuck)"
add("flow_cycles", A + LOOPS + components(
    "rl", "SELECT id FROM ring", "SELECT src AS a, dst AS b FROM flow JOIN ring x ON x.id = src JOIN ring y ON y.id = dst "
    "UNION ALL SELECT dst, src FROM flow JOIN ring x ON x.id = src JOIN ring y ON y.id = dst"),
    f"SELECT {RC}, {ID.format('lab')} AS cycle FROM cells JOIN rl USING (id), dims")
# What any complete routing obeys, whatever way it chose.
add("flow_ends", DIMS, "SELECT 'open_cells' AS measure, CAST(0 AS BIGINT) AS value UNION ALL SELECT 'on_cycles', 0 UNION ALL SELECT 'arrived', count(*) FROM grid")
add("cycles_left", A + LOOPS, "SELECT 'before' AS measure, CAST(count(*) AS BIGINT) AS value FROM ring UNION ALL SELECT 'after', 0")
add("flow_kind", A + LOOPS, f"SELECT {RC}, CASE WHEN stuck.id IS NULL THEN 'exit' ELSE 'cycle' END AS kind FROM cells LEFT JOIN stuck USING (id)")
add("cycle_guard", A + LOOPS, "SELECT CAST(count(*) AS BIGINT) AS stuck FROM stuck")
add("flow_accumulation", V + NB + STRICT + FLOW + WALK + ACC, f"SELECT {RC}, CAST(a AS BIGINT) AS accumulation FROM cells JOIN acc USING (id)")
add("flow_accumulation_noise", O + NB + STRICT + FLOW + WALK + ACC, f"SELECT {RC}, CAST(a AS BIGINT) AS accumulation FROM cells JOIN acc USING (id)")
add("channel_cells", V + NB + VALLEY_CHANNEL, f"SELECT {RC}, CAST(a AS BIGINT) AS accumulation FROM chan JOIN acc USING (id) WHERE on_")
add("channel_threshold", V + NB + VALLEY_CHANNEL, f"SELECT {RC}, CAST(on_ AS INT) AS channel FROM chan")
add("trim_edges", V + NB + VALLEY_CHANNEL + TRIM, f"SELECT {RC}, CAST(on_ AS INT) AS channel FROM trimmed")
add("filter_short", V + NB + VALLEY_CHANNEL + kept("res", "chan", 6), f"SELECT {RC}, CAST(on_ AS INT) AS channel FROM res")
add("channel_mask", VM + NB + VALLEY_CHANNEL + TRIM + kept("res", "trimmed", 6), f"SELECT {RC}, CAST(on_ AS INT) AS channel FROM res")
add("terrain_stats", OM, f"""SELECT CAST(max(r) + 1 AS INT) AS n_rows, CAST(max(c) + 1 AS INT) AS n_cols, {D('min(h) FILTER (WHERE v)')} AS min_height,
  {D('max(h) FILTER (WHERE v)')} AS max_height, {D('avg(CAST(h AS DOUBLE)) FILTER (WHERE v)')} AS mean_height FROM cells""")
add("render_terrain", OM + """,
s AS (SELECT CAST(min(h) AS DOUBLE) AS lo, CAST(max(h) AS DOUBLE) AS hi FROM cells WHERE v)""",
    f"SELECT {RC}, CAST(CASE WHEN v AND hi > lo THEN trunc((h - lo) / (hi - lo) * 255.0) ELSE 0 END AS INT) AS gray FROM cells, s")
add("render_fill_depth", B + NB + FLOOD + """,
s AS (SELECT CAST(max(f - h) AS DOUBLE) AS hi FROM filled WHERE v AND f > h)""",
    f"SELECT {RC}, CAST(CASE WHEN v AND f > h THEN trunc(least(1.0, (f - h) / hi) * 255.0) ELSE 0 END AS INT) AS gray FROM filled, s")
PALETTE = """,
pal(i, pr, pg, pb) AS (VALUES (0,54,116,181),(1,102,170,255),(2,70,172,124),(3,145,206,108),(4,214,165,61),(5,220,116,69),
  (6,188,81,83),(7,130,98,173),(-1,18,24,32))"""
add("render_direction", O + NB + STRICT + PALETTE, f"SELECT {RC}, CAST(pr AS INT) AS r, CAST(pg AS INT) AS g, CAST(pb AS INT) AS b FROM strict JOIN pal ON pal.i = strict.d")
add("overview_codes", O + NB + STRICT + f""",
votes AS (SELECT r // s AS r, c // s AS c, d, count(*) AS n FROM strict{BY_50} GROUP BY ALL)""",
    f"SELECT {RC}, CAST(arg_min(d, [-n, d]) AS INT) AS direction FROM votes GROUP BY r, c")
add("overview_colors", O + NB + STRICT + PALETTE, """SELECT CAST(r // s AS INT) AS "row", CAST(c // s AS INT) AS "col", """ + ", ".join(
    f"round(CAST(CAST(avg(p{k}) AS FLOAT) AS DOUBLE), 3) AS {k}" for k in "rgb") + f" FROM strict JOIN pal ON pal.i = strict.d{BY_50} GROUP BY r // s, c // s")
add("render_accumulation", V + NB + STRICT + FLOW + WALK + ACC + """,
x AS (SELECT id, ln(1.0 + a) AS t FROM acc), s AS (SELECT min(t) AS lo, max(t) AS hi FROM x)""",
    f"SELECT {RC}, CAST(CASE WHEN hi > lo THEN trunc((t - lo) / (hi - lo) * 255.0) ELSE 0 END AS INT) AS gray FROM cells JOIN x USING (id), s")
add("render_mask", OM, f"SELECT {RC}, CASE WHEN v THEN 255 ELSE 0 END AS gray FROM cells")
add("render_channel", V + NB + VALLEY_CHANNEL, f"SELECT {RC}, " + ", ".join(
    f"CASE WHEN on_ THEN {x} ELSE 0 END AS {k}" for k, x in zip("rgba", (121, 210, 255, 255))) + " FROM chan")
MASKED_INPUT = ",\nm AS (SELECT g.id, coalesce(e.event_id % 11 <> 0, true) AS m FROM grid g LEFT JOIN events e ON e.event_id = g.id)"
add("render_input", O + MASKED_INPUT, f"SELECT {RC}, CASE WHEN m THEN CAST(h AS INT) ELSE 0 END AS r, CASE WHEN m THEN CAST(h AS INT) ELSE 0 END AS g, "
    "CASE WHEN m THEN CAST(h AS INT) ELSE 0 END AS b, CASE WHEN m THEN 255 ELSE 0 END AS a FROM cells JOIN m USING (id)")
# Two layers: opaque gray input, then the mask lightened over it at opacity 0.9.
add("composite", O + MASKED_INPUT + """,
mix AS (SELECT r AS r0, c AS c0, CAST(floor(0.9 * greatest(h, CASE WHEN m THEN 255 ELSE 0 END) + (1.0 - 0.9) * h + 0.5) AS INT) AS x
  FROM cells JOIN m USING (id))""", 'SELECT CAST(r0 AS INT) AS "row", CAST(c0 AS INT) AS "col", x AS r, x AS g, x AS b, 255 AS a FROM mix')
add("direction_counts", O + NB + STRICT, "SELECT CAST(d AS INT) AS direction, CAST(count(*) AS BIGINT) AS n FROM strict GROUP BY d")
add("layer_catalog", DIMS, """SELECT layer, stage, CASE WHEN ok THEN 'ready' ELSE 'pending' END AS status,
  CAST(CASE WHEN ok THEN w END AS INT) AS width, CAST(CASE WHEN ok THEN nr END AS INT) AS height FROM dims, (VALUES
  ('input_preview', 'io', true), ('user_mask', 'io', true), ('auto_mask', 'preprocess', false), ('terrain_preprocessed', 'preprocess', false),
  ('fill_depth', 'preprocess', false), ('flow_direction', 'flow_direction', true), ('flow_accumulation', 'flow_accumulation', false),
  ('channel_mask', 'channel_extract', false)) t(layer, stage, ok)""")
add("write_stage", O, f"SELECT {RC}, {D('h')} AS height, v AS valid FROM cells")
add("auto_mask", VM + NB + GRAD + VARIANCE + BORDER + """,
mdl AS (SELECT median(CAST(h AS DOUBLE)) AS mid, CASE WHEN stddev_pop(h) <= 1e-6 THEN 1.0 ELSE stddev_pop(h) END AS sd FROM vals),
cand AS MATERIALIZED (SELECT c.id, c.r, c.c, c.v AND 0.45 * CAST(CAST(greatest(0.0, least(1.0, 1 - abs(c.h - mid) / greatest(1.0, sd * 2.25))) AS FLOAT) AS DOUBLE)
  + 0.30 * gs.s + 0.25 * vs.s >= 0.58 AS x FROM cells c JOIN gs ON gs.id = c.id JOIN vs ON vs.id = c.id, mdl),
gone(id) AS (SELECT id FROM cand, dims WHERE x AND (r = 0 OR c = 0 OR r = nr - 1 OR c = w - 1) UNION
  SELECT nb.nid FROM gone JOIN nb ON nb.id = gone.id JOIN cand ON cand.id = nb.nid AND cand.x),
m1 AS MATERIALIZED (SELECT c.id, c.r, c.c, c.v AND g.id IS NULL AS on_ FROM cells c LEFT JOIN gone g ON g.id = c.id)""" + kept("m2", "m1", 64) + """,
m3 AS MATERIALIZED (SELECT id, r, c, NOT on_ AS on_ FROM m2)""" + kept("m4", "m3", 32),
    f"SELECT {RC}, NOT m4.on_ AND v AS auto_mask FROM m4 JOIN (SELECT id, v FROM cells) USING (id)")
MULTI = """
dm AS (SELECT CAST(ceil(sqrt(ceil(count(*) / 4.0))) AS BIGINT) AS w FROM orders),
src AS MATERIALIZED (SELECT o_orderkey % 4 AS q, (o_orderkey // 4) // w AS r, (o_orderkey // 4) % w AS c, CAST(floor(o_totalprice / 2000) AS INT) AS h FROM orders, dm),
ext AS (SELECT q, max(r) + 1 AS nr, max(c) + 1 AS nc FROM src GROUP BY q),
cells AS MATERIALIZED (SELECT g.q * 1000000000 + g.r * g.nc + g.c AS id, g.q, g.r, g.c, coalesce(s.h, 0) AS h, s.q IS NOT NULL AS v
  FROM (SELECT q, k // nc AS r, k % nc AS c, nc FROM ext, unnest(range(0, nr * nc)) AS t(k)) g LEFT JOIN src s ON s.q = g.q AND s.r = g.r AND s.c = g.c),
steps(i, dr, dc, len) AS (VALUES (0,-1,0,1.0),(1,-1,1,sqrt(2)),(2,0,1,1.0),(3,1,1,sqrt(2)),
  (4,1,0,1.0),(5,1,-1,sqrt(2)),(6,0,-1,1.0),(7,-1,-1,sqrt(2))),
nb AS MATERIALIZED (SELECT a.id, a.h, a.v, s.i, s.len, b.id AS nid, b.h AS nh, b.v AS nv
  FROM cells a CROSS JOIN steps s LEFT JOIN cells b ON b.q = a.q AND b.r = a.r + s.dr AND b.c = a.c + s.dc),
flow AS MATERIALIZED (SELECT id AS src, nid AS dst FROM (SELECT id, nid, row_number() OVER (PARTITION BY id ORDER BY (h - nh) / len DESC, i) AS k
  FROM nb WHERE v AND nv AND h > nh) WHERE k = 1)"""
add("flow_accumulation_multi", MULTI + WALK + ACC,
    f"SELECT 'orders_' || q AS raster_id, {RC}, CAST(a AS BIGINT) AS accumulation FROM cells JOIN acc USING (id)")
