"""DuckDB oracle SQL for the registered queries (independent of the engine code).

Each string runs on DuckDB with the driver's tables registered as views.
DuckDB reads ``0.2`` as DECIMAL, so every fractional literal is written as a
DOUBLE cast to keep IEEE arithmetic identical to Spark's.
"""

from __future__ import annotations


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def HASH(col: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5(CAST({col} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT)"


def R(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


# ---------------------------------------------------------------- carriers
DQ = f"""
dq0 AS (
  SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS label,
         CASE WHEN CAST(substr(d.source, 4) AS INTEGER) % 2 = 0 THEN 'a' ELSE 'b' END AS origin,
         CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS n_words,
         len(list_distinct(string_split(d.text, ' '))) / len(string_split(d.text, ' ')) AS uniq_ratio,
         length(regexp_replace(d.text, '[A-Za-z ]', '', 'g')) / greatest(length(d.text), 1) AS nonalpha_ratio,
         d.lang AS lang, CAST(l.toxic AS INTEGER) AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
dq AS (SELECT row_id, label, origin, n_chars, n_words, uniq_ratio, nonalpha_ratio, toxic,
              CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code FROM dq0)"""

LI = """
li AS (
  SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
                       CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))) AS row_id,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_linestatus AS origin,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem)"""

ORD = """
ord AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"""

LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DOC_CONT = ["n_chars", "n_words", "uniq_ratio", "nonalpha_ratio"]
DOC_CAT = ["lang_code", "toxic"]


def split_cte(name: str, src: str, frac, k, stratify: bool = True) -> str:
    """Exact rank split/folds: test = rank < ceil(frac·n), fold = (rank − n_test) % k."""
    part = "PARTITION BY label" if stratify else ""
    nt = f"CAST(ceil(n * {D(frac)}) AS BIGINT)" if frac is not None else "CAST(0 AS BIGINT)"
    fold = f", CASE WHEN rk >= nt THEN CAST((rk - nt) % {k} AS INTEGER) END AS fold" if k else ""
    return f"""
{name}_r AS (SELECT *, row_number() OVER ({part} ORDER BY h, row_id) - 1 AS rk,
                 count(*) OVER ({part}) AS n
          FROM (SELECT *, {HASH('row_id')} AS h FROM {src})),
{name} AS (SELECT * EXCLUDE (h, rk, n, nt), CASE WHEN rk < nt THEN 'test' ELSE 'train' END AS split{fold}
        FROM (SELECT *, {nt} AS nt FROM {name}_r))"""


def width_bin(x: str, lo: str, hi: str, n: int) -> str:
    return f"least(greatest(CAST(floor(({x} - {lo}) / ({hi} - {lo}) * {n}) AS INTEGER), 0), {n - 1})"


# doc table split with 3 folds and width-16 bins of the two flagship features
PREP = DQ + "," + split_cte("s", "dq", 0.2, 3) + f""",
bb AS (SELECT min(uniq_ratio) lo_u, max(uniq_ratio) hi_u, min(nonalpha_ratio) lo_n, max(nonalpha_ratio) hi_n,
              min(n_chars) lo_c, max(n_chars) hi_c, min(n_words) lo_w, max(n_words) hi_w
       FROM s WHERE split = 'train'),
p AS (SELECT s.*, {width_bin('uniq_ratio', 'lo_u', 'hi_u', 16)} AS bu,
             {width_bin('nonalpha_ratio', 'lo_n', 'hi_n', 16)} AS bn,
             {width_bin('n_chars', 'lo_c', 'hi_c', 16)} AS bc,
             {width_bin('n_words', 'lo_w', 'hi_w', 16)} AS bw
      FROM s, bb)"""


def rate_model(tag: str, bincol: str, k: int = 3, prior: float = 1.0, src: str = "p",
               where: str = "split = 'train'") -> str:
    return f""",
cnt_{tag} AS (SELECT fold, {bincol} AS bin, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n
              FROM {src} WHERE {where} GROUP BY 1, 2),
tot_{tag} AS (SELECT bin, sum(pos) AS tpos, sum(n) AS tn FROM cnt_{tag} GROUP BY bin),
per_{tag} AS (SELECT f.fold, t.bin,
                     (t.tpos - coalesce(c.pos, 0) + {D(prior)}) / (t.tn - coalesce(c.n, 0) + {D(2 * prior)}) AS rate
              FROM tot_{tag} t CROSS JOIN (SELECT range AS fold FROM range(0, {k})) f
              LEFT JOIN cnt_{tag} c ON c.fold = f.fold AND c.bin = t.bin),
m_{tag} AS (SELECT fold, bin, rate FROM per_{tag} UNION ALL SELECT -1 AS fold, bin, avg(rate) FROM per_{tag} GROUP BY bin)"""


SCORED = PREP + rate_model("u", "bu") + rate_model("n", "bn") + f""",
sc AS (SELECT p.row_id, p.label, p.split, p.fold, p.origin,
              coalesce(mu.rate, {D(0.5)}) AS p_uniq, coalesce(mn.rate, {D(0.5)}) AS p_nonalpha
       FROM p LEFT JOIN m_u mu ON mu.fold = coalesce(p.fold, -1) AND mu.bin = p.bu
              LEFT JOIN m_n mn ON mn.fold = coalesce(p.fold, -1) AND mn.bin = p.bn),
bl AS (SELECT *, (p_uniq + p_nonalpha) / {D(2)} AS score FROM sc)"""


def metric_rows(src: str) -> str:
    """auc/accuracy/precision/recall/f1 of (label, score) rows in ``src`` at 0.5."""
    return f""",
mt AS (SELECT label, score, CAST(score >= {D(0.5)} AS INTEGER) AS pred FROM {src}),
mg AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM mt GROUP BY score),
mc AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM mg),
ma AS (SELECT sum(pos * (nb + neg / {D(2)})) / nullif({D('sum(pos)')} * {D('sum(neg)')}, 0) AS auc FROM mc),
mq AS (SELECT {D("sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS tp,
              {D("sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS fp,
              {D("sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END)")} AS fn,
              avg(CASE WHEN label = pred THEN {D(1)} ELSE {D(0)} END) AS acc FROM mt)
SELECT 'auc' AS metric, round(auc, 6) AS value FROM ma
UNION ALL SELECT 'accuracy', round(acc, 6) FROM mq
UNION ALL SELECT 'precision', round(coalesce(tp / nullif(tp + fp, 0), 0), 6) FROM mq
UNION ALL SELECT 'recall', round(coalesce(tp / nullif(tp + fn, 0), 0), 6) FROM mq
UNION ALL SELECT 'f1', round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) FROM mq"""


FIXED = DQ + f""",
fx AS (SELECT *, round(uniq_ratio, 3) AS score, CAST(round(uniq_ratio, 3) >= {D(0.5)} AS INTEGER) AS pred FROM dq)"""

CURVE = FIXED + f""",
cg AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM fx GROUP BY score),
cc AS (SELECT score, pos, neg,
              sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
              sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM cg)"""


def _unpivot(src: str, cols: list[str], extra: str = "origin") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)


def describe_sql(carrier: str, src: str, cols: list[str]) -> str:
    return f"""WITH {carrier}, lg AS ({_unpivot(src, cols)})
SELECT origin, feature, count(value) AS n, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
       round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(min(value), 6) AS min,
       round(max(value), 6) AS max, CAST(sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros
FROM lg GROUP BY origin, feature"""


def ks_sql(carrier: str, src: str, cols: list[str], a: str, b: str) -> str:
    return f"""WITH {carrier}, lg AS ({_unpivot(src, cols)}),
cnt AS (SELECT feature, value, sum(CASE WHEN origin = '{a}' THEN 1 ELSE 0 END) AS ca,
               sum(CASE WHEN origin = '{b}' THEN 1 ELSE 0 END) AS cb
        FROM lg WHERE value IS NOT NULL GROUP BY feature, value),
cum AS (SELECT feature, ca, cb,
               sum(ca) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS fa,
               sum(cb) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS fb,
               sum(ca) OVER (PARTITION BY feature) AS na, sum(cb) OVER (PARTITION BY feature) AS nb FROM cnt)
SELECT feature, round(max(abs({D('fa')} / nullif(na, 0) - {D('fb')} / nullif(nb, 0))), 6) AS ks,
       CAST(sum(ca) AS BIGINT) AS n_a, CAST(sum(cb) AS BIGINT) AS n_b
FROM cum GROUP BY feature"""


DOC_RULES = {
    "n_chars": "n_chars >= 1",
    "n_words": "n_words >= 1",
    "uniq_ratio": "uniq_ratio > 0 AND uniq_ratio <= 1",
    "nonalpha_ratio": "nonalpha_ratio >= 0 AND nonalpha_ratio <= 1",
    "lang_code": "lang_code >= 0",
    "label": "label IN (0, 1)",
}
LINE_RULES = {
    "l_quantity": "l_quantity > 0",
    "l_extendedprice": "l_extendedprice > 0",
    "l_discount": "l_discount >= 0 AND l_discount <= 0.1",
    "l_tax": "l_tax >= 0 AND l_tax <= 0.08",
}


def domain_sql(carrier: str, src: str, rules: dict[str, str]) -> str:
    parts = [f"""SELECT origin, count(*) AS rows, '{c}' AS feature,
       CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls,
       CAST(sum(CASE WHEN {c} IS NOT NULL AND NOT ({pred}) THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM {src} GROUP BY origin""" for c, pred in rules.items()]
    return f"WITH {carrier}\n" + "\nUNION ALL\n".join(parts)


def _pairs(cols):
    return [(x, y) for i, x in enumerate(cols) for y in cols[i + 1:]]


DUP = "l_quantity, l_discount, l_tax, l_returnflag"


def metric_rows_by(src: str) -> str:
    """Per-model auc/accuracy/precision/recall/f1 of (model, label, score) rows."""
    return f""",
mt AS (SELECT model, label, score, CAST(score >= {D(0.5)} AS INTEGER) AS pred FROM {src}),
mg AS (SELECT model, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM mt GROUP BY model, score),
mc AS (SELECT model, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM mg),
ma AS (SELECT model, sum(pos * (nb + neg / {D(2)})) / nullif({D('sum(pos)')} * {D('sum(neg)')}, 0) AS auc
       FROM mc GROUP BY model),
mq AS (SELECT model, {D("sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS tp,
              {D("sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS fp,
              {D("sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END)")} AS fn,
              avg(CASE WHEN label = pred THEN {D(1)} ELSE {D(0)} END) AS acc FROM mt GROUP BY model)
SELECT model, 'auc' AS metric, round(auc, 6) AS value FROM ma
UNION ALL SELECT model, 'accuracy', round(acc, 6) FROM mq
UNION ALL SELECT model, 'precision', round(coalesce(tp / nullif(tp + fp, 0), 0), 6) FROM mq
UNION ALL SELECT model, 'recall', round(coalesce(tp / nullif(tp + fn, 0), 0), 6) FROM mq
UNION ALL SELECT model, 'f1', round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) FROM mq"""


GRID_FEATURES = [("uniq_ratio", "bu"), ("nonalpha_ratio", "bn"), ("n_chars", "bc"), ("n_words", "bw")]
GRID_PRIORS = [1.0, 10.0]
GRID = [(i, f, b, a) for i, ((f, b), a) in enumerate((fb, a) for fb in GRID_FEATURES for a in GRID_PRIORS)]
GRID_LONG = PREP + "".join(rate_model(f"g{i}", b, 3, a) for i, f, b, a in GRID) + ",\ngl AS (" + \
    " UNION ALL ".join(
        f"SELECT p.fold, p.label, {i} AS config_id, '{f}' AS feature, {D(a)} AS prior, "
        f"coalesce(m.rate, {D(0.5)}) AS score FROM p LEFT JOIN m_g{i} m ON m.fold = coalesce(p.fold, -1) "
        f"AND m.bin = p.{b} WHERE p.split = 'train'" for i, f, b, a in GRID) + ")," + """
gf AS (SELECT config_id, feature, prior, fold,
              avg(CASE WHEN label = CAST(score >= CAST(0.5 AS DOUBLE) AS INTEGER) THEN CAST(1 AS DOUBLE)
                       ELSE CAST(0 AS DOUBLE) END) AS accuracy
       FROM gl GROUP BY config_id, feature, prior, fold)"""

OOF_LONG = SCORED + f""",
ol AS (SELECT fold, label, 'p_uniq' AS model, p_uniq AS p FROM bl WHERE split = 'train'
       UNION ALL SELECT fold, label, 'p_nonalpha', p_nonalpha FROM bl WHERE split = 'train'
       UNION ALL SELECT fold, label, 'blend', score FROM bl WHERE split = 'train'),
of AS (SELECT model, fold, avg(CASE WHEN label = CAST(p >= {D(0.5)} AS INTEGER) THEN {D(1)} ELSE {D(0)} END) AS accuracy
       FROM ol GROUP BY model, fold)"""


# first boosting round at the root (width-16 bins, feature order as the engine's bins array)
ROOT = PREP + f""",
nb AS (SELECT greatest(max(lang_code) + 1, 2) AS nl, greatest(max(toxic) + 1, 2) AS nt FROM p WHERE split = 'train'),
tr AS (SELECT p.*, least(greatest(lang_code, 0), nl - 1) AS bl, least(greatest(toxic, 0), nt - 1) AS bt
       FROM p, nb WHERE split = 'train'),
p0 AS (SELECT avg(label) AS r FROM tr)"""

ROOT_FEATURES = ["bc", "bw", "bu", "bn", "bl", "bt"]


def root_hist_cte(g: str, h: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {i} AS f, {b} AS b, {g} AS g, {h} AS h FROM tr, p0" for i, b in enumerate(ROOT_FEATURES))
    return f""",
gr AS ({parts}),
hist AS (SELECT f, b, sum(g) AS G, sum(h) AS H, CAST(count(*) AS DOUBLE) AS C FROM gr GROUP BY f, b),
cum AS (SELECT f, b, sum(G) OVER (PARTITION BY f ORDER BY b ROWS UNBOUNDED PRECEDING) AS GL,
               sum(H) OVER (PARTITION BY f ORDER BY b ROWS UNBOUNDED PRECEDING) AS HL,
               sum(C) OVER (PARTITION BY f ORDER BY b ROWS UNBOUNDED PRECEDING) AS CL,
               sum(G) OVER (PARTITION BY f) AS Gt, sum(H) OVER (PARTITION BY f) AS Ht,
               sum(C) OVER (PARTITION BY f) AS Ct FROM hist),
lr AS (SELECT *, Gt - GL AS GR, Ht - HL AS HR, Ct - CL AS CR FROM cum)"""


NEWTON_G = f"(r - CAST(label AS DOUBLE))"
GBM_G = f"(CAST(label AS DOUBLE) - r)"
PH = f"(r * ({D(1)} - r))"
GAIN = {
    "newton": f"{D(0.5)} * (GL * GL / (HL + {D(1)}) + GR * GR / (HR + {D(1)}) - Gt * Gt / (Ht + {D(1)}))",
    "variance": "GL * GL / CL + GR * GR / CR - Gt * Gt / Ct",
    "gini": f"{D(2)} * Gt * (Ht - Gt) / Ht - {D(2)} * GL * (HL - GL) / HL - {D(2)} * GR * (HR - GR) / HR",
}
VALID = {
    "newton": f"CL >= 1 AND CR >= 1 AND Ct >= 2 AND HL >= {D(1)} AND HR >= {D(1)}",
    "variance": "CL >= 1 AND CR >= 1 AND Ct >= 2",
    "gini": "CL >= 1 AND CR >= 1 AND Ct >= 2 AND HL > 0 AND HR > 0",
}


def root_split_sql(kind: str, g: str, h: str) -> str:
    return f"""WITH {ROOT}{root_hist_cte(g, h)},
cand AS (SELECT *, {GAIN[kind]} AS gain FROM lr WHERE {VALID[kind]}),
best AS (SELECT * FROM cand WHERE gain > {D(1e-12)} ORDER BY round(gain, 9) DESC, f ASC, b ASC LIMIT 1)"""


# ---------------------------------------------------------------- whole rounds
def xs_cte(src: str, exprs: list[str]) -> str:
    """Features in long form: row_id, f, x (null: missing)."""
    return "xs AS (" + " UNION ALL ".join(f"SELECT row_id, {i} AS f, {D(e)} AS x FROM {src}" for i, e in enumerate(exprs)) + ")"


def tree_ctes(t: str, src: str, depth: int, kind: str, raw: bool) -> str:
    """CTEs that grow one tree over ``src (row_id, g, h)``: splits {t}_b<level>, final nodes {t}_n<depth>."""
    out = [f"{t}_n0 AS (SELECT row_id, g, h, 1 AS node FROM {src})"]
    cut = "CASE WHEN nx IS NULL OR x / 2 + nx / 2 >= nx THEN x ELSE x / 2 + nx / 2 END" if raw else "x"
    sums = lambda s: (f"sum(CASE WHEN x IS NOT NULL THEN {s} END) OVER o AS {s}x, "  # noqa: E731
                      f"coalesce(sum(CASE WHEN x IS NULL THEN {s} END) OVER a, 0) AS {s}m, sum({s}) OVER a AS {s}t")
    for i in range(depth):
        out.append(f"""{t}_h{i} AS (SELECT node, f, x, sum(g) AS G, sum(h) AS H, CAST(count(*) AS DOUBLE) AS C
    FROM {t}_n{i} JOIN xs USING (row_id) WHERE node >= {2 ** i} GROUP BY node, f, x),
{t}_c{i} AS (SELECT node, f, x, lead(x) OVER (PARTITION BY node, f ORDER BY x NULLS FIRST) AS nx, {sums('G')}, {sums('H')}, {sums('C')}
    FROM {t}_h{i} WINDOW o AS (PARTITION BY node, f ORDER BY x NULLS FIRST ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY node, f)),
{t}_o{i} AS (SELECT node, f, x, nx, Gt, Ht, Ct, Gx AS GL, Hx AS HL, Cx AS CL, Cm <= 0 AND 2 * Cx >= Ct AS ml FROM {t}_c{i} WHERE x IS NOT NULL
    UNION ALL SELECT node, f, x, nx, Gt, Ht, Ct, Gx + Gm, Hx + Hm, Cx + Cm, true FROM {t}_c{i} WHERE x IS NOT NULL AND Cm > 0),
{t}_g{i} AS (SELECT *, {GAIN[kind]} AS gain FROM (SELECT *, Gt - GL AS GR, Ht - HL AS HR, Ct - CL AS CR FROM {t}_o{i}) WHERE {VALID[kind]}),
{t}_b{i} AS (SELECT node, f, {cut} AS cut, ml, gain, GL, CL, GR, CR FROM {t}_g{i} WHERE gain > {D(1e-12)}
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f, x, ml) = 1),
{t}_n{i + 1} AS (SELECT n.row_id, g, h, CASE WHEN b.node IS NULL THEN n.node
        ELSE 2 * n.node + CASE WHEN v.x > b.cut OR (v.x IS NULL AND NOT b.ml) THEN 1 ELSE 0 END END AS node
    FROM {t}_n{i} n LEFT JOIN {t}_b{i} b ON b.node = n.node LEFT JOIN xs v ON v.row_id = n.row_id AND v.f = b.f)""")
    return ",\n".join(out)


def tree_rows(t: str, number: int, depth: int, leaf: str, raw: bool, more: str = "", more_leaf: str = "") -> str:
    """The tree's rows: splits, then leaves with the value ``leaf`` over sums of g and h."""
    cut = "round(cut, 6)" if raw else "CAST(cut AS INTEGER)"
    none = "CAST(NULL AS DOUBLE)" if raw else "CAST(NULL AS INTEGER)"
    parts = [f"SELECT {number} AS tree, CAST(node AS BIGINT) AS node, f AS feature, {cut} AS cut, CAST(NULL AS DOUBLE) AS leaf{more} FROM {t}_b{i}"
             for i in range(depth)]
    parts.append(f"SELECT {number}, CAST(node AS BIGINT), CAST(NULL AS INTEGER), {none}, {leaf}{more_leaf} FROM {t}_n{depth} GROUP BY node")
    return "\nUNION ALL ".join(parts)


TRAIN = DQ + "," + split_cte("s", "dq", 0.2, 3) + ", tr AS (SELECT * FROM s WHERE split = 'train')"
RAW = [*DOC_CONT, *DOC_CAT]


def boost_ctes(rounds: int, depth: int, kind: str, lr: float, leaf: str, raw: bool) -> str:
    """f0, then per round: gradients, a tree, new scores."""
    g = "p - y" if kind == "newton" else "y - p"
    out = ["f0 AS (SELECT row_id, CAST(label AS DOUBLE) AS y, ln(r / (1 - r)) AS s FROM tr, (SELECT avg(label) AS r FROM tr))"]
    for i in range(rounds):
        out += [f"gh{i} AS (SELECT row_id, {g} AS g, p * (1 - p) AS h FROM (SELECT row_id, y, 1 / (1 + exp(-s)) AS p FROM f{i}))",
                tree_ctes(f"t{i}", f"gh{i}", depth, kind, raw),
                f"v{i} AS (SELECT node, {D(lr)} * {leaf} AS v FROM t{i}_n{depth} GROUP BY node)",
                f"f{i + 1} AS (SELECT f{i}.row_id, y, s + v AS s FROM f{i} JOIN t{i}_n{depth} USING (row_id) JOIN v{i} USING (node))"]
    return ",\n".join(out)


def quantile_ctes(long: str, n_bins: int, weight: str = "count(*)") -> str:
    """qc(f, b, hi): the bins' largest values; ``long (f, x)`` holds the training values."""
    fits = f"w * ({n_bins} - r + 1) <= tot - above"
    return f"""qd AS (SELECT f, x, {weight} AS w FROM {long} WHERE x IS NOT NULL GROUP BY f, x),
qo AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY w DESC, x) AS r, sum(w) OVER (PARTITION BY f) AS tot, count(*) OVER (PARTITION BY f) AS n,
              sum(w) OVER (PARTITION BY f ORDER BY w DESC, x ROWS UNBOUNDED PRECEDING) - w AS above FROM qd),
ql AS (SELECT f, CASE WHEN max(n) <= {n_bins} THEN max(n) ELSE min(CASE WHEN {fits} THEN r END) - 1 END AS heavy,
              CASE WHEN max(n) <= {n_bins} THEN 0 ELSE max(CASE WHEN {fits} THEN tot - above END) END AS light FROM qo GROUP BY f),
qs AS (SELECT f, x, light, heavy, CASE WHEN light = 0 OR w * ({n_bins} - heavy) > light THEN 1 ELSE 0 END AS big, w FROM qd JOIN ql USING (f)),
qb AS (SELECT f, x, coalesce(sum(big) OVER o, 0) + CASE WHEN light = 0 THEN 0
                    ELSE coalesce(sum((1 - big) * w) OVER o, 0) * ({n_bins} - heavy) // light END AS b FROM qs
       WINDOW o AS (PARTITION BY f ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
qc AS (SELECT f, CAST(b AS INTEGER) AS b, max(x) AS hi, CAST(max(max(b)) OVER (PARTITION BY f) AS INTEGER) AS last FROM qb GROUP BY f, b)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_typed"] = f"""WITH {DQ}
SELECT row_id, label, origin, {R('n_chars', 'n_chars')}, {R('n_words', 'n_words')},
       {R('uniq_ratio', 'uniq_ratio')}, {R('nonalpha_ratio', 'nonalpha_ratio')}, toxic, lang_code FROM dq"""
    q["rename_columns"] = "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"
    q["feature_projection"] = f"WITH {LI} SELECT row_id, label, {', '.join(LINE_COLS)} FROM li"
    roles = [("row_id", "bigint", "key"), ("label", "int", "label"), ("origin", "string", "other"),
             ("n_chars", "double", "continuous"), ("n_words", "double", "continuous"),
             ("uniq_ratio", "double", "continuous"), ("nonalpha_ratio", "double", "continuous"),
             ("toxic", "int", "categorical"), ("lang_code", "int", "categorical")]
    q["table_info"] = f"WITH {DQ}\n" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS col_name, '{t}' AS type, '{r}' AS role, count({c}) AS non_null, count(*) AS rows FROM dq"
        for c, t, r in roles)
    q["preview_topk"] = f"""WITH {DQ}
SELECT row_id, label, origin, {R('n_chars', 'n_chars')}, {R('n_words', 'n_words')},
       {R('uniq_ratio', 'uniq_ratio')}, {R('nonalpha_ratio', 'nonalpha_ratio')}, toxic, lang_code
FROM dq ORDER BY row_id LIMIT 5"""
    split3 = DQ + "," + split_cte("s", "dq", 0.2, 3)
    q["split_counts"] = f"WITH {split3} SELECT split, label, count(*) AS n FROM s GROUP BY split, label"
    q["fold_filter"] = f"WITH {split3} SELECT row_id, label, fold FROM s WHERE split = 'train' AND fold <> 1"
    q["threshold_label"] = f"WITH {FIXED} SELECT row_id, score, pred FROM fx"
    q["split_hash"] = f"""WITH {ORD}
SELECT row_id, CASE WHEN {HASH('row_id')} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM ord"""
    q["split_exact"] = f"WITH {ORD}, {split_cte('s', 'ord', 0.2, None, False)} SELECT row_id, split FROM s"
    q["split_stratified"] = f"WITH {ORD}, {split_cte('s', 'ord', 0.2, None, True)} SELECT row_id, label, split FROM s"
    q["kfold_hash"] = f"WITH {ORD} SELECT row_id, CAST({HASH('row_id')} % 5 AS INTEGER) AS fold FROM ord"
    q["kfold_assign"] = f"WITH {ORD}, {split_cte('s', 'ord', None, 5, False)} SELECT row_id, fold FROM s"
    q["kfold_stratified"] = f"WITH {ORD}, {split_cte('s', 'ord', None, 5, True)} SELECT row_id, label, fold FROM s"
    q["fold_balance"] = f"""WITH {split3}
SELECT fold, label, count(*) AS n FROM s WHERE split = 'train' GROUP BY ROLLUP (fold, label)"""
    scaled = ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN {D(1)} ELSE s_{c} END, 6) AS {c}"
        for c in LINE_COLS)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_COLS)
    q["scale_fit_transform"] = f"WITH {LI}, pr AS (SELECT {stats} FROM li) SELECT row_id, {scaled} FROM li, pr"
    lsplit = LI + "," + split_cte("s", "li", 0.2, 3)
    q["scale_train_apply_test"] = f"""WITH {lsplit}, pr AS (SELECT {stats} FROM s WHERE split = 'train')
SELECT row_id, {scaled} FROM s, pr WHERE split = 'test'"""
    bnds = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE_COLS)
    bins = ", ".join(f"{width_bin(c, f'lo_{c}', f'hi_{c}', 16)} AS b_{c}" for c in LINE_COLS)
    q["bin_features"] = f"""WITH {lsplit}, bb AS (SELECT {bnds} FROM s WHERE split = 'train')
SELECT row_id, {bins} FROM s, bb"""
    q["oof_table"] = f"""WITH {SCORED}
SELECT row_id, label, fold, {R('p_uniq', 'p_uniq')}, {R('p_nonalpha', 'p_nonalpha')} FROM sc WHERE split = 'train'"""
    q["fold_average"] = f"""WITH {SCORED}
SELECT row_id, label, {R('p_uniq', 'p_uniq')}, {R('p_nonalpha', 'p_nonalpha')} FROM sc WHERE split = 'test'"""
    q["blend_metrics"] = f"WITH {SCORED}, tst AS (SELECT label, score FROM bl WHERE split = 'test')" + metric_rows("tst")
    q["metric_accuracy"] = f"""WITH {FIXED}
SELECT origin, round(avg(CASE WHEN label = pred THEN {D(1)} ELSE {D(0)} END), 6) AS accuracy FROM fx GROUP BY origin"""
    q["metric_auc"] = f"""WITH {LI},
t AS (SELECT origin, label, round(l_extendedprice / {D(105000)}, 3) AS score FROM li),
g AS (SELECT origin, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM t GROUP BY origin, score),
c AS (SELECT origin, pos, neg, coalesce(sum(neg) OVER (PARTITION BY origin ORDER BY score
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT origin, round(sum(pos * (nb + neg / {D(2)})) / nullif({D('sum(pos)')} * {D('sum(neg)')}, 0), 6) AS auc
FROM c GROUP BY origin"""
    q["metric_auc_doc"] = f"""WITH {FIXED},
g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
             sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM fx GROUP BY score),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT round(sum(pos * (nb + neg / {D(2)})) / nullif({D('sum(pos)')} * {D('sum(neg)')}, 0), 6) AS auc FROM c"""
    q["metric_report"] = f"""WITH {FIXED},
cm AS (SELECT {D("sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END)")} AS c00,
              {D("sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END)")} AS c01,
              {D("sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END)")} AS c10,
              {D("sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS c11 FROM fx),
cls AS (SELECT '0' AS class, coalesce(c00 / nullif(c00 + c10, 0), 0) AS precision,
               coalesce(c00 / nullif(c00 + c01, 0), 0) AS recall,
               coalesce(2 * c00 / nullif(2 * c00 + c10 + c01, 0), 0) AS f1, CAST(c00 + c01 AS BIGINT) AS support,
               (c00 + c11) / (c00 + c01 + c10 + c11) AS acc FROM cm
        UNION ALL
        SELECT '1', coalesce(c11 / nullif(c11 + c01, 0), 0), coalesce(c11 / nullif(c11 + c10, 0), 0),
               coalesce(2 * c11 / nullif(2 * c11 + c01 + c10, 0), 0), CAST(c11 + c10 AS BIGINT),
               (c00 + c11) / (c00 + c01 + c10 + c11) FROM cm)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cls
UNION ALL SELECT 'accuracy', NULL, NULL, round(max(acc), 6), CAST(sum(support) AS BIGINT) FROM cls
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM cls
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM cls"""
    q["metric_prf"] = f"""WITH {FIXED},
cm AS (SELECT origin, {D("sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS tp,
              {D("sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END)")} AS fp,
              {D("sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END)")} AS fn,
              avg(CASE WHEN label = pred THEN {D(1)} ELSE {D(0)} END) AS acc FROM fx GROUP BY origin)
SELECT origin, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(acc, 6) AS accuracy FROM cm"""
    q["confusion"] = f"""WITH {FIXED}, cells AS (SELECT l, p FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(l, p))
SELECT c.l AS label, c.p AS pred, CAST(count(fx.row_id) AS BIGINT) AS n
FROM cells c LEFT JOIN fx ON fx.label = c.l AND fx.pred = c.p GROUP BY c.l, c.p"""
    q["roc_points"] = f"""WITH {CURVE}
SELECT round(score, 6) AS threshold, round({D('fp')} / nullif(N, 0), 6) AS fpr, round({D('tp')} / nullif(P, 0), 6) AS tpr FROM cc"""
    q["pr_points"] = f"""WITH {CURVE}
SELECT round(score, 6) AS threshold, round({D('tp')} / nullif(tp + fp, 0), 6) AS precision,
       round({D('tp')} / nullif(P, 0), 6) AS recall FROM cc"""
    q["metric_ap"] = f"""WITH {CURVE}
SELECT round(sum(pos * ({D('tp')} / nullif(tp + fp, 0))) / {D('max(P)')}, 6) AS average_precision FROM cc"""
    # ------------------------------------------------------------ fidelity
    q["describe_by_source"] = describe_sql(DQ, "dq", DOC_CONT)
    q["describe_lineitem"] = describe_sql(LI, "li", LINE_COLS)
    q["category_tvd"] = f"""WITH {DQ}, lg AS ({_unpivot('dq', DOC_CAT + ['label'])}),
cnt AS (SELECT feature, value, sum(CASE WHEN origin = 'a' THEN 1 ELSE 0 END) AS ca,
               sum(CASE WHEN origin = 'b' THEN 1 ELSE 0 END) AS cb FROM lg WHERE value IS NOT NULL GROUP BY feature, value),
sh AS (SELECT feature, coalesce({D('ca')} / nullif(sum(ca) OVER (PARTITION BY feature), 0), 0) AS sa,
              coalesce({D('cb')} / nullif(sum(cb) OVER (PARTITION BY feature), 0), 0) AS sb FROM cnt)
SELECT feature, round({D(0.5)} * sum(abs(sa - sb)), 6) AS tvd, count(*) AS n_values FROM sh GROUP BY feature"""
    q["ks_two_sample"] = ks_sql(DQ, "dq", DOC_CONT, "a", "b")
    q["ks_lineitem"] = ks_sql(LI, "li", LINE_COLS, "F", "O")
    pb = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in DOC_CONT)
    pbins = " UNION ALL ".join(
        f"SELECT origin, '{c}' AS feature, {width_bin(f'CAST({c} AS DOUBLE)', f'lo_{c}', f'hi_{c}', 10)} AS bin FROM dq, bb"
        for c in DOC_CONT)
    q["psi_js"] = f"""WITH {DQ}, bb AS (SELECT {pb} FROM dq), lg AS ({pbins}),
cnt AS (SELECT feature, bin, sum(CASE WHEN origin = 'a' THEN 1 ELSE 0 END) AS ca,
               sum(CASE WHEN origin = 'b' THEN 1 ELSE 0 END) AS cb FROM lg WHERE bin IS NOT NULL GROUP BY feature, bin),
sh AS (SELECT feature, greatest({D('ca')} / sum(ca) OVER (PARTITION BY feature), {D(1e-6)}) AS pa,
              greatest({D('cb')} / sum(cb) OVER (PARTITION BY feature), {D(1e-6)}) AS pb FROM cnt)
SELECT feature, round(sum((pa - pb) * ln(pa / pb)), 6) AS psi,
       round({D(0.5)} * sum(pa * ln(pa / ((pa + pb) / 2))) + {D(0.5)} * sum(pb * ln(pb / ((pa + pb) / 2))), 6) AS js
FROM sh GROUP BY feature"""
    cols = DOC_CONT + ["label"]
    corr_parts = " UNION ALL ".join(
        f"SELECT origin, '{x}' AS col_x, '{y}' AS col_y, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r FROM dq GROUP BY origin"
        for x, y in _pairs(cols))
    q["corr_delta"] = f"""WITH {DQ}, lg AS ({corr_parts}),
w AS (SELECT col_x, col_y, max(CASE WHEN origin = 'a' THEN r END) AS ca, max(CASE WHEN origin = 'b' THEN r END) AS cb
      FROM lg GROUP BY col_x, col_y)
SELECT col_x, col_y, round(ca, 6) AS corr_a, round(cb, 6) AS corr_b, round(ca - cb, 6) AS delta FROM w"""
    q["domain_violations"] = domain_sql(DQ, "dq", DOC_RULES)
    q["domain_violations_lineitem"] = domain_sql(LI, "li", LINE_RULES)
    q["duplicate_rows"] = f"""WITH g AS (SELECT l_linestatus AS origin, {DUP}, count(*) AS copies FROM lineitem
                   GROUP BY l_linestatus, {DUP})
SELECT origin, count(*) AS dup_groups, CAST(sum(copies) AS BIGINT) AS dup_rows,
       CAST(sum(copies - 1) AS BIGINT) AS extra_copies, max(copies) AS max_copies
FROM g WHERE copies > 1 GROUP BY origin"""
    q["source_overlap"] = f"""WITH d AS (SELECT {DUP}, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS in_a,
                          max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS in_b FROM lineitem GROUP BY {DUP})
SELECT CAST(sum(in_a) AS BIGINT) AS distinct_a, CAST(sum(in_b) AS BIGINT) AS distinct_b,
       CAST(sum(in_a * in_b) AS BIGINT) AS shared FROM d"""
    cat_lg = " UNION ALL ".join(
        f"SELECT origin, label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM dq" for c in DOC_CAT)
    pbis = " UNION ALL ".join(
        f"SELECT origin, '{c}' AS feature, 'point_biserial' AS measure, round(corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE)), 6) AS value FROM dq GROUP BY origin"
        for c in DOC_CONT)
    q["label_association"] = f"""WITH {DQ}, lg AS ({cat_lg}),
cell AS (SELECT origin, feature, value, label, count(*) AS o FROM lg WHERE value IS NOT NULL GROUP BY ALL),
rt AS (SELECT origin, feature, value, sum(o) AS rt FROM cell GROUP BY ALL),
ct AS (SELECT origin, feature, label, sum(o) AS ct FROM cell GROUP BY ALL),
nn AS (SELECT origin, feature, sum(o) AS n, count(DISTINCT value) AS nv, count(DISTINCT label) AS nl FROM cell GROUP BY ALL),
fl AS (SELECT r.origin, r.feature, coalesce(cell.o, 0) AS o, {D('r.rt * c.ct')} / nn.n AS e
       FROM rt r JOIN ct c ON r.origin = c.origin AND r.feature = c.feature
       JOIN nn ON nn.origin = r.origin AND nn.feature = r.feature
       LEFT JOIN cell ON cell.origin = r.origin AND cell.feature = r.feature AND cell.value = r.value AND cell.label = c.label),
chi AS (SELECT fl.origin, fl.feature, sum((o - e) * (o - e) / e) AS chi2 FROM fl GROUP BY fl.origin, fl.feature),
cv AS (SELECT chi.origin, chi.feature, chi.chi2, sqrt(chi.chi2 / nullif(nn.n * (least(nn.nv, nn.nl) - 1), 0)) AS v
       FROM chi JOIN nn ON nn.origin = chi.origin AND nn.feature = chi.feature)
SELECT origin, feature, 'chi2' AS measure, round(chi2, 6) AS value FROM cv
UNION ALL SELECT origin, feature, 'cramers_v', round(v, 6) FROM cv
UNION ALL {pbis}"""
    q["grid_cv_scores"] = f"""WITH {GRID_LONG}
SELECT config_id, feature, prior, fold, round(accuracy, 6) AS accuracy FROM gf"""
    q["grid_select"] = f"""WITH {GRID_LONG},
gm AS (SELECT config_id, feature, prior, round(avg(accuracy), 9) AS mean_score FROM gf GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (ORDER BY mean_score DESC, config_id ASC) AS rk FROM gm)
SELECT config_id, feature, prior, round(mean_score, 6) AS mean_accuracy FROM gr WHERE rk = 1"""
    q["cv_summary"] = f"""WITH {OOF_LONG}
SELECT model, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy,
       count(*) AS folds FROM of GROUP BY model"""
    q["fold_metric_mean"] = f"""WITH {OOF_LONG},
bg AS (SELECT fold, p, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM ol WHERE model = 'blend' GROUP BY fold, p),
bc AS (SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY p
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM bg),
ba AS (SELECT fold, sum(pos * (nb + neg / {D(2)})) / nullif({D('sum(pos)')} * {D('sum(neg)')}, 0) AS auc
       FROM bc GROUP BY fold),
pf AS (SELECT o.fold, o.accuracy, a.auc FROM of o JOIN ba a ON a.fold = o.fold WHERE o.model = 'blend')
SELECT round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy,
       round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc FROM pf"""
    q["model_leaderboard"] = f"""WITH {SCORED},
tl AS (SELECT label, 'p_uniq' AS model, p_uniq AS score FROM bl WHERE split = 'test'
       UNION ALL SELECT label, 'p_nonalpha', p_nonalpha FROM bl WHERE split = 'test'
       UNION ALL SELECT label, 'blend', score FROM bl WHERE split = 'test'),
lg AS (SELECT model, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
              sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM tl GROUP BY model, score),
lc AS (SELECT model, pos, neg, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM lg),
mv AS (SELECT model, 'auc' AS metric,
              round(sum(pos * (nb + neg / {D(2)})) / nullif({D('sum(pos)')} * {D('sum(neg)')}, 0), 6) AS value
       FROM lc GROUP BY model
       UNION ALL
       SELECT model, 'accuracy', round(avg(CASE WHEN label = CAST(score >= {D(0.5)} AS INTEGER)
                                                THEN {D(1)} ELSE {D(0)} END), 6) FROM tl GROUP BY model)
SELECT model, metric, value, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank FROM mv"""
    q["two_source_eval"] = f"""WITH {DQ},
ab AS (SELECT min(uniq_ratio) lo_u, max(uniq_ratio) hi_u, min(nonalpha_ratio) lo_n, max(nonalpha_ratio) hi_n
       FROM dq WHERE origin = 'a'),
tb AS (SELECT dq.*, {width_bin('uniq_ratio', 'lo_u', 'hi_u', 16)} AS bu,
              {width_bin('nonalpha_ratio', 'lo_n', 'hi_n', 16)} AS bn FROM dq, ab),
mu AS (SELECT bu, (CAST(sum(label) AS DOUBLE) + {D(1)}) / (CAST(count(*) AS DOUBLE) + {D(2)}) AS r
       FROM tb WHERE origin = 'a' GROUP BY bu),
mn AS (SELECT bn, (CAST(sum(label) AS DOUBLE) + {D(1)}) / (CAST(count(*) AS DOUBLE) + {D(2)}) AS r
       FROM tb WHERE origin = 'a' GROUP BY bn),
ev AS (SELECT tb.label, coalesce(mu.r, {D(0.5)}) AS pu, coalesce(mn.r, {D(0.5)}) AS pn
       FROM tb LEFT JOIN mu ON mu.bu = tb.bu LEFT JOIN mn ON mn.bn = tb.bn WHERE tb.origin = 'b'),
el AS (SELECT 'p_uniq' AS model, label, pu AS score FROM ev UNION ALL SELECT 'p_nonalpha', label, pn FROM ev
       UNION ALL SELECT 'blend', label, (pu + pn) / {D(2)} FROM ev)""" + metric_rows_by("el")
    q["newton_hist"] = f"""WITH {ROOT}{root_hist_cte(NEWTON_G, PH)}
SELECT f AS feature, b AS bin, round(G, 6) AS g_sum, round(H, 6) AS h_sum, CAST(C AS BIGINT) AS rows FROM hist"""
    cols = """f AS feature, b AS cut, round(gain, 6) AS gain, round(GL, 6) AS g_left, round(HL, 6) AS h_left,
       CAST(CL AS BIGINT) AS n_left, round(GR, 6) AS g_right, round(HR, 6) AS h_right, CAST(CR AS BIGINT) AS n_right"""
    q["newton_round"] = root_split_sql("newton", NEWTON_G, PH) + f"\nSELECT {cols} FROM best"
    q["gbm_round"] = root_split_sql("variance", GBM_G, PH) + f"\nSELECT {cols} FROM best"
    q["ada_stump_round"] = root_split_sql("gini", "CAST(label AS DOUBLE)", D(1)) + f""",
e AS (SELECT *, (least(round(GL, 6), round(HL, 6) - round(GL, 6)) + least(round(GR, 6), round(HR, 6) - round(GR, 6)))
               / (round(HL, 6) + round(HR, 6)) AS err FROM best)
SELECT f AS feature, b AS cut, round(gain, 6) AS gain, CAST(CL AS BIGINT) AS n_left, CAST(CR AS BIGINT) AS n_right,
       round(err, 6) AS err, round(ln(({D(1)} - err) / err), 6) AS alpha FROM e"""
    feat_case = "CASE best.f " + " ".join(
        f"WHEN {i} THEN CAST({b} > best.b AS INTEGER)" for i, b in enumerate(ROOT_FEATURES)) + " END"
    parts1 = " UNION ALL ".join(
        f"SELECT node, {i} AS f, {b} AS b, {NEWTON_G} AS g, {PH} AS h FROM l1, p0" for i, b in enumerate(ROOT_FEATURES))
    lr = D(0.3)
    # inner folds: the training rows ranked again under the second seed, per label
    q["nested_folds"] = f"""WITH {DQ}, {split_cte('s', 'dq', 0.2, 3)},
i_r AS (SELECT row_id, row_number() OVER (PARTITION BY label ORDER BY h, row_id) - 1 AS rk
        FROM (SELECT row_id, label, {HASH('row_id', 43)} AS h FROM s WHERE split = 'train'))
SELECT s.row_id, s.split, s.fold, CAST(i_r.rk % 3 AS INTEGER) AS inner FROM s LEFT JOIN i_r ON i_r.row_id = s.row_id"""
    q["newton_tree_depth2"] = root_split_sql("newton", NEWTON_G, PH) + f""",
l1 AS (SELECT tr.*, 2 + {feat_case} AS node FROM tr, best),
g1 AS ({parts1}),
h1 AS (SELECT node, f, b, sum(g) AS G, sum(h) AS H, CAST(count(*) AS DOUBLE) AS C FROM g1 GROUP BY node, f, b),
c1 AS (SELECT node, f, b, sum(G) OVER (PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING) AS GL,
              sum(H) OVER (PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING) AS HL,
              sum(C) OVER (PARTITION BY node, f ORDER BY b ROWS UNBOUNDED PRECEDING) AS CL,
              sum(G) OVER (PARTITION BY node, f) AS Gt, sum(H) OVER (PARTITION BY node, f) AS Ht,
              sum(C) OVER (PARTITION BY node, f) AS Ct FROM h1),
r1 AS (SELECT *, Gt - GL AS GR, Ht - HL AS HR, Ct - CL AS CR FROM c1),
k1 AS (SELECT *, {GAIN['newton']} AS gain FROM r1 WHERE {VALID['newton']}),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, f ASC, b ASC) AS rn
                      FROM k1 WHERE gain > {D(1e-12)}) WHERE rn = 1),
t1 AS (SELECT node, sum(G) AS G, sum(H) AS H FROM h1 WHERE f = 0 GROUP BY node)
SELECT CAST(1 AS BIGINT) AS node, f AS feature, b AS cut, CAST(NULL AS DOUBLE) AS leaf FROM best
UNION ALL SELECT CAST(node AS BIGINT), f, b, NULL FROM b1
UNION ALL SELECT CAST(t1.node AS BIGINT), NULL, NULL, round({lr} * (-t1.G / (t1.H + {D(1)})), 6)
          FROM t1 WHERE t1.node NOT IN (SELECT node FROM b1)
UNION ALL SELECT CAST(2 * node AS BIGINT), NULL, NULL, round({lr} * (-GL / (HL + {D(1)})), 6) FROM b1
UNION ALL SELECT CAST(2 * node + 1 AS BIGINT), NULL, NULL, round({lr} * (-GR / (HR + {D(1)})), 6) FROM b1"""
    q["gbm_rounds_exact"] = f"""WITH {TRAIN}, {xs_cte('tr', RAW)},
{boost_ctes(2, 2, 'variance', 0.1, 'sum(g) / sum(h)', True)}
""" + "\nUNION ALL ".join(tree_rows(f"t{i}", i, 2, f"round({D(0.1)} * sum(g) / sum(h), 6)", True) for i in range(2))
    for name, kind, g, h in (("gbm_round_exact", "variance", GBM_G, PH), ("ada_stump_exact", "gini", D("label"), D(1))):
        q[name] = f"""WITH {TRAIN}, {xs_cte('tr', RAW)},
gh AS (SELECT row_id, {g} AS g, {h} AS h FROM tr, (SELECT avg(label) AS r FROM tr)),
{tree_ctes('t', 'gh', 1, kind, True)}
SELECT f AS feature, round(cut, 6) AS cut, round(gain, 6) AS gain, round(GL, 6) AS g_left, CAST(CL AS BIGINT) AS n_left,
       round(GR, 6) AS g_right, CAST(CR AS BIGINT) AS n_right FROM t_b0"""
    ada, rows = ["w0 AS (SELECT row_id, label, CAST(1 AS DOUBLE) AS w FROM tr)"], []
    for i in range(3):
        ada += [f"gh{i} AS (SELECT row_id, w * label AS g, w AS h FROM w{i})", tree_ctes(f"t{i}", f"gh{i}", 1, "gini", True),
                f"y{i} AS (SELECT node, CASE WHEN sum(g) > sum(h) - sum(g) THEN 1 ELSE 0 END AS y FROM t{i}_n1 GROUP BY node)",
                f"e{i} AS (SELECT ln((1 - err) / err) AS alpha FROM (SELECT sum(CASE WHEN y <> label THEN w ELSE 0 END) / sum(w) AS err "
                f"FROM w{i} JOIN t{i}_n1 USING (row_id) JOIN y{i} USING (node)))",
                f"u{i} AS (SELECT row_id, label, w * exp(alpha * CASE WHEN y <> label THEN 1 ELSE 0 END) AS w "
                f"FROM w{i} JOIN t{i}_n1 USING (row_id) JOIN y{i} USING (node), e{i})",
                f"w{i + 1} AS (SELECT row_id, label, w / (SELECT sum(w) FROM u{i}) AS w FROM u{i})"]
        alpha = f", (SELECT round(alpha, 6) FROM e{i}) AS alpha"
        rows.append(tree_rows(f"t{i}", i, 1, "CASE WHEN sum(g) > sum(h) - sum(g) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", True, alpha, alpha))
    q["ada_rounds_exact"] = f"WITH {TRAIN}, {xs_cte('tr', RAW)},\n" + ",\n".join(ada) + "\n" + "\nUNION ALL ".join(rows)
    holes = {"n_words": "CASE WHEN n_words % 5 <> 0 THEN n_words END", "uniq_ratio": "CASE WHEN toxic = 0 OR n_chars > 500 THEN uniq_ratio END"}
    q["newton_rounds_missing"] = f"""WITH {TRAIN}, {xs_cte('tr', [holes.get(c, c) for c in DOC_CONT]).replace('xs AS', 'xv AS', 1)},
{quantile_ctes('xv', 255)},
xs AS (SELECT row_id, xv.f, CASE WHEN xv.x IS NOT NULL THEN CAST(least(coalesce(qc.b + 1, 0), qm.last) AS DOUBLE) END AS x
       FROM xv ASOF LEFT JOIN qc ON xv.f = qc.f AND xv.x > qc.hi JOIN (SELECT DISTINCT f, last FROM qc) qm ON qm.f = xv.f
       UNION ALL SELECT row_id, 4, CAST(lang_code AS DOUBLE) FROM tr UNION ALL SELECT row_id, 5, CAST(toxic AS DOUBLE) FROM tr),
{boost_ctes(2, 2, 'newton', 0.3, f'(-sum(g) / (sum(h) + 1))', False)}
""" + "\nUNION ALL ".join(tree_rows(f"t{i}", i, 2, f"round({D(0.3)} * (-sum(g) / (sum(h) + 1)), 6)", False, ", ml AS missing_left", ", NULL")
                          for i in range(2))
    # lines are told apart by number: two lines may share their key columns
    lx = f"SELECT rn, row_id, split, unnest([0, 1, 2, 3]) AS f, unnest([{', '.join(LINE_COLS)}]) AS x FROM (SELECT *, row_number() OVER () AS rn FROM s)"
    q["bin_quantile"] = f"""WITH {lsplit}, lx AS MATERIALIZED ({lx}), lt AS (SELECT f, x FROM lx WHERE split = 'train'),
{quantile_ctes('lt', 255)},
lb AS (SELECT rn, row_id, lx.f, least(coalesce(qc.b + 1, 0), qm.last) AS b FROM lx ASOF LEFT JOIN qc ON lx.f = qc.f AND lx.x > qc.hi
       JOIN (SELECT DISTINCT f, last FROM qc) qm ON qm.f = lx.f)
SELECT row_id, {", ".join(f"CAST(max(CASE WHEN f = {i} THEN b END) AS INTEGER) AS b_{c}" for i, c in enumerate(LINE_COLS))} FROM lb GROUP BY rn, row_id"""
    for name, cte, src, cols in (("quartiles_by_source", DQ, "dq", DOC_CONT), ("quartiles_lineitem", LI, "li", LINE_COLS)):
        q[name] = f"WITH {cte}\n" + "\nUNION ALL ".join(
            f"SELECT origin, '{c}' AS feature, {', '.join(f'round(quantile_cont({c}, {D(p)}), 6) AS q{round(100 * p)}' for p in (0.25, 0.5, 0.75))} "
            f"FROM {src} GROUP BY origin" for c in cols)
    spark_type = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' END"
    known = lambda t, cs: " UNION ALL ".join(f"SELECT '{c}' AS col_name, count({e}) AS n FROM {t}" for c, e in cs)
    q["schema_match"] = f"""WITH a AS (SELECT column_name AS col_name, CASE column_name WHEN 'doc_id' THEN 'string' ELSE {spark_type} END AS type_a
       FROM (DESCRIBE SELECT * FROM documents)),
b AS (SELECT column_name AS col_name, {spark_type} AS type_b FROM (DESCRIBE SELECT * FROM labels) UNION ALL SELECT 'text', 'string'),
ka AS ({known('documents', [(c, c) for c in ('doc_id', 'text', 'lang', 'source', 'n_chars')])}),
kb AS ({known('labels', [('doc_id', 'doc_id'), ('quality', 'quality'), ('toxic', 'toxic'), ('text', 'NULL')])})
SELECT col_name, type_a, type_b, type_a IS NOT DISTINCT FROM type_b AS matches, ka.n AS known_a, kb.n AS known_b
FROM a FULL JOIN b USING (col_name) LEFT JOIN ka USING (col_name) LEFT JOIN kb USING (col_name)"""
    runs = (("source-a", "fixed", "WHERE origin = 'a'"), ("source-b", "fixed", "WHERE origin = 'b'"), ("source-a", "all", ""))
    q["metric_sink"] = "\nUNION ALL ".join(
        f"SELECT '{study}' AS study, '{run}' AS run, CAST(NULL AS VARCHAR) AS model, metric, value FROM "
        f"(WITH {FIXED}, src AS (SELECT label, score FROM fx {where}){metric_rows('src')})" for study, run, where in runs)
    q["kfold_grouped"] = f"""WITH {LI},
gc AS (SELECT md5(concat_ws('|', CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_tax AS VARCHAR))) AS content,
              label, count(*) AS n FROM li GROUP BY 1, 2),
gm AS (SELECT content, label AS f, sum(n) OVER (PARTITION BY content) AS w FROM gc
       QUALIFY row_number() OVER (PARTITION BY content ORDER BY n DESC, label) = 1),
gx AS (SELECT content, f, w, CAST('0x' || substr(md5(content || '|42'), 1, 13) AS BIGINT) AS x FROM gm),
{quantile_ctes('gx', 5, 'CAST(sum(w) AS BIGINT)')},
gf AS (SELECT content, CAST(least(coalesce(qc.b + 1, 0), qm.last) AS INTEGER) AS fold FROM gx ASOF LEFT JOIN qc ON gx.f = qc.f AND gx.x > qc.hi
       JOIN (SELECT DISTINCT f, last FROM qc) qm ON qm.f = gx.f)
SELECT md5(content || '|' || label || '|' || i) AS row_id, content, label, fold
FROM (SELECT content, label, unnest(range(n)) AS i FROM gc) JOIN gf USING (content)"""
    return q
