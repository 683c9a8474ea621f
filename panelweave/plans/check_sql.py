"""SQL building blocks of the checks: the customer panel, written independently."""

from __future__ import annotations

# Yearly facts per customer, the long form, entity types.
FACTS = """
per_order AS (
  SELECT l_orderkey, sum(l_quantity) AS order_quantity FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year,
         round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS DOUBLE) AS n_orders,
         sum(order_quantity) AS quantity
  FROM orders LEFT JOIN per_order ON o_orderkey = l_orderkey
  GROUP BY 1, 2),
years AS (
  SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
  WHERE o_orderdate IS NOT NULL),
long AS (
  SELECT entity, 'revenue' AS indicator, year, revenue AS value FROM facts
  UNION ALL SELECT entity, 'n_orders', year, n_orders FROM facts
  UNION ALL SELECT entity, 'quantity', year, quantity FROM facts WHERE quantity IS NOT NULL
  UNION ALL SELECT c_custkey, 'acctbal', year, c_acctbal FROM customer, years),
types AS (
  SELECT n_name AS country,
         CASE WHEN n_nationkey % 5 = 0 THEN 'Group' ELSE 'Country' END AS entity_type
  FROM nation WHERE n_nationkey NOT IN (23, 24)),
entities AS (
  SELECT c_custkey AS entity, n_name AS country, entity_type, c_acctbal AS acctbal
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN types ON n_name = types.country)
"""

PANEL = f"""{FACTS},
panel AS (
  SELECT e.entity, e.country, e.entity_type, f.revenue, f.n_orders, f.quantity, e.acctbal
  FROM entities e LEFT JOIN facts f ON f.entity = e.entity AND f.year = 1996)
"""

BAND_COLUMNS = """,
         least(f.n_orders, 3.0::DOUBLE) AS orders_band,
         CAST(least(floor(f.quantity / 50), 5) AS DOUBLE) AS quantity_band,
         CAST(floor(e.acctbal / 1000) AS DOUBLE) AS balance_band"""


def model_rows(more: str = "") -> str:
    """Complete numeric rows of the train and test year."""
    return f"""{FACTS},
model_rows AS (
  SELECT f.entity, f.year, f.revenue, f.n_orders, f.quantity, e.acctbal{more}
  FROM facts f JOIN entities e ON e.entity = f.entity
  WHERE f.quantity IS NOT NULL),
train AS (SELECT * FROM model_rows WHERE year = 1996),
test AS (SELECT * FROM model_rows WHERE year = 1997)
"""


MODEL_ROWS = model_rows(BAND_COLUMNS)


def least_squares(rows: str = MODEL_ROWS) -> str:
    """The least-squares line of revenue on n_orders, fitted on train, scored on test."""
    return f"""{rows},
line AS (
  SELECT regr_slope(revenue, n_orders) AS slope, regr_intercept(revenue, n_orders) AS intercept,
         regr_r2(revenue, n_orders) AS r2
  FROM train),
scored AS (
  SELECT entity, revenue, n_orders, intercept + slope * n_orders AS prediction FROM test, line)
"""


LINE = least_squares()

# A tree on one predictor, grown until each of its values is a leaf of its own:
# the leaf holds the mean label, an unseen value falls to the nearest one, the
# lower on ties (splits lie halfway between neighbours).
LEAVES = f"""{MODEL_ROWS},
leaves AS (SELECT n_orders AS x, avg(revenue) AS mean FROM train GROUP BY 1),
nearest AS (
  SELECT t.x, arg_min(mean, abs(leaves.x - t.x) * 1000 + leaves.x) AS prediction
  FROM (SELECT DISTINCT n_orders AS x FROM test) t, leaves GROUP BY t.x),
leaf_scored AS (
  SELECT entity, revenue, n_orders, prediction FROM test JOIN nearest ON x = n_orders)
"""


def unpivot_columns(table: str, columns: tuple[str, ...], keep: str = "entity") -> str:
    """One row per table row and column, missing values included."""
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS indicator, CAST({c} AS DOUBLE) AS value FROM {table}"
        for c in columns
    )


PREDICTORS = ("n_orders", "quantity", "acctbal")
BANDS = ("orders_band", "quantity_band", "balance_band")


def rows_with(predictors: tuple[str, ...]) -> str:
    """The model rows, with bands if those are the predictors."""
    return MODEL_ROWS if predictors == BANDS else model_rows()


def midpoints(predictors: tuple[str, ...]) -> str:
    """Midpoints between neighbouring values of each predictor: where a tree may split."""
    return f"""
midpoints AS (
  SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS threshold
  FROM (SELECT DISTINCT indicator AS f, value AS v
        FROM ({unpivot_columns('train', predictors)})))
"""


def split_value(stump: str, predictors: tuple[str, ...] = PREDICTORS) -> str:
    """The row's value of the predictor that a stump splits on."""
    cases = " ".join(f"WHEN '{p}' THEN {p}" for p in predictors)
    return f"CASE {stump}.f {cases} END"


def stump(name: str, rows: str, target: str, predictors: tuple[str, ...]) -> str:
    """CTEs giving the split that leaves the least squared error: predictor, threshold, means."""
    return f"""
{name}_values AS (
  SELECT f, v, count(*) AS n, sum(t) AS s FROM (
    {" UNION ALL ".join(f"SELECT '{p}' AS f, {p} AS v, {target} AS t FROM {rows}" for p in predictors)})
  GROUP BY f, v),
{name}_sums AS (
  SELECT f, v, sum(n) OVER before AS nl, sum(s) OVER before AS sl,
         sum(n) OVER (PARTITION BY f) AS nt, sum(s) OVER (PARTITION BY f) AS st
  FROM {name}_values WINDOW before AS (PARTITION BY f ORDER BY v)),
{name} AS (
  SELECT f, threshold, sl / nl AS low, (st - sl) / (nt - nl) AS high
  FROM {name}_sums JOIN midpoints USING (f, v) WHERE nl < nt
  ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1)"""


def stump_prediction(name: str, predictors: tuple[str, ...] = PREDICTORS) -> str:
    value = split_value(name, predictors)
    return f"CASE WHEN {value} <= {name}.threshold THEN {name}.low ELSE {name}.high END"


def tree2(predictors: tuple[str, ...] = PREDICTORS) -> str:
    """A tree of depth two on all predictors."""
    root = split_value("root", predictors)
    return f"""{rows_with(predictors)}, {midpoints(predictors)},
{stump('root', 'train', 'revenue', predictors)},
sides AS (SELECT train.*, {root} <= root.threshold AS is_low FROM train, root),
low_rows AS (SELECT * FROM sides WHERE is_low),
high_rows AS (SELECT * FROM sides WHERE NOT is_low),
{stump('low_side', 'low_rows', 'revenue', predictors)},
{stump('high_side', 'high_rows', 'revenue', predictors)},
tree_scored AS (
  SELECT entity, revenue, CASE WHEN {root} <= root.threshold
    THEN {stump_prediction('low_side', predictors)} ELSE {stump_prediction('high_side', predictors)} END AS prediction
  FROM test, root, low_side, high_side)
"""


def boosted_stumps(rounds: int, step: float = 0.1, predictors: tuple[str, ...] = PREDICTORS) -> str:
    """Boosting with stumps: each fits twice the error left by those before it."""
    parts = [rows_with(predictors), midpoints(predictors), "train0 AS (SELECT *, 0.0::DOUBLE AS fitted FROM train)",
             "test0 AS (SELECT *, 0.0::DOUBLE AS fitted FROM test)"]
    for i in range(rounds):
        target, weight = ("revenue", 1.0) if i == 0 else ("2 * (revenue - fitted)", step)
        parts.append(stump(f"stump{i}", f"train{i}", target, predictors))
        for side in ("train", "test"):
            parts.append(
                f"{side}{i + 1} AS (SELECT {side}{i}.* EXCLUDE (fitted), "
                f"fitted + {weight} * {stump_prediction(f'stump{i}', predictors)} AS fitted FROM {side}{i}, stump{i})"
            )
    return ",\n".join(parts)


def solve3(name: str, source: str, d: str, rhs: tuple[str, str, str]) -> str:
    """CTE adding x1..x3 that solve the symmetric system of r12, r13, r23 with diagonal ``d``."""
    p, q, r = (f"({e})" for e in rhs)
    d, a, b, c = f"({d})", "r12", "r13", "r23"
    det = f"({d}*({d}*{d}-{c}*{c}) - {a}*({a}*{d}-{b}*{c}) + {b}*({a}*{c}-{b}*{d}))"
    return f"""
{name} AS (SELECT *,
  ({p}*({d}*{d}-{c}*{c}) - {a}*({q}*{d}-{c}*{r}) + {b}*({q}*{c}-{d}*{r})) / {det} AS {name}1,
  ({d}*({q}*{d}-{c}*{r}) - {p}*({a}*{d}-{c}*{b}) + {b}*({a}*{r}-{q}*{b})) / {det} AS {name}2,
  ({d}*({d}*{r}-{q}*{c}) - {a}*({a}*{r}-{q}*{b}) + {p}*({a}*{c}-{d}*{b})) / {det} AS {name}3
  FROM {source})"""


# Elastic net (0.3, mix 0.8) on the three predictors, all of them staying in:
# in standard units the coefficients solve a linear system once their signs,
# those of least squares, are known.
NET = f"""{MODEL_ROWS},
moments AS (
  SELECT corr(n_orders, quantity) AS r12, corr(n_orders, acctbal) AS r13, corr(quantity, acctbal) AS r23,
         corr(n_orders, revenue) AS r1, corr(quantity, revenue) AS r2, corr(acctbal, revenue) AS r3,
         stddev_samp(revenue) AS sy, stddev_samp(n_orders) AS s1, stddev_samp(quantity) AS s2,
         stddev_samp(acctbal) AS s3, avg(revenue) AS my, avg(n_orders) AS m1, avg(quantity) AS m2,
         avg(acctbal) AS m3 FROM train),
{solve3('ols', 'moments', '1', ('r1', 'r2', 'r3'))},
{solve3('net', 'ols', '1 + 0.2 * 0.3 / sy', tuple(f'r{i} - 0.8 * 0.3 / sy * sign(ols{i})' for i in (1, 2, 3)))},
net_line AS (
  SELECT net1 * sy / s1 AS b1, net2 * sy / s2 AS b2, net3 * sy / s3 AS b3,
         my - net1 * sy / s1 * m1 - net2 * sy / s2 * m2 - net3 * sy / s3 * m3 AS b0 FROM net),
net_scored AS (
  SELECT rows.*, b0 + b1 * n_orders + b2 * quantity + b3 * acctbal AS prediction
  FROM model_rows AS rows, net_line)
"""
