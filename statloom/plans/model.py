"""Model facade: batches of queries and rows as DataFrames, storage as tables, comparison with exact answers."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.plans import nodes as N
from statloom.plans.export import as_text, from_text
from statloom.plans.learn import Params, learn
from statloom.sources.context import Context


class Model:
    """A learned model of a table of `rows` rows.

    Evaluation sends the model (bounded by the learner's parameters) to every task and takes the queries or rows as they are
    partitioned: no shuffle, and work in proportion to the batch.
    """

    def __init__(self, root: N.Node, rows: int, spark: SparkSession):
        self.root, self.rows, self.spark = root, rows, spark

    @classmethod
    def fit(cls, df: DataFrame, context: Context | None = None, params: Params | None = None) -> Model:
        return cls(learn(df, context, params), df.count(), df.sparkSession)

    def _map(self, df: DataFrame, fn, schema: str) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(pickle.dumps(self.root))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            root = pickle.loads(shared.value)  # noqa: S301  written by this class
            for b in batches:
                if len(b):
                    yield fn(root, b)

        return df.mapInPandas(run, schema)

    def probability(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, <c>_lo and <c>_hi for any columns; null is unbounded) -> query_id, selectivity, cardinality."""
        n, scope = self.rows, list(self.root.scope)

        def fn(root: N.Node, b: pd.DataFrame) -> pd.DataFrame:
            lo, hi = _bounds(b, scope)
            p = N.probability(root, lo, hi, len(b))
            return pd.DataFrame({"query_id": b["query_id"], "selectivity": p, "cardinality": p * n})

        return self._map(queries, fn, "query_id long, selectivity double, cardinality double")

    def expectation(self, queries: DataFrame, powers: dict[str, int]) -> DataFrame:
        """E[prod x_c^powers[c] 1(query)] per query, and the expectation given the query."""
        scope = list(self.root.scope)

        def fn(root: N.Node, b: pd.DataFrame) -> pd.DataFrame:
            lo, hi = _bounds(b, scope)
            e, p = N.expectation(root, lo, hi, len(b), powers), N.probability(root, lo, hi, len(b))
            return pd.DataFrame({"query_id": b["query_id"], "e": e, "conditional": np.divide(e, p, out=np.full(len(e), np.nan), where=p > 0)})

        return self._map(queries, fn, "query_id long, e double, conditional double")

    def log_likelihood(self, rows: DataFrame, keep: str, given: list[str] | None = None) -> DataFrame:
        """keep, ll: of each row (null cells are summed out); with given, of the other columns given those."""
        scope = list(self.root.scope)

        def fn(root: N.Node, b: pd.DataFrame) -> pd.DataFrame:
            x = {c: b[c].to_numpy(float) for c in scope if c in b}
            ll = N.log_likelihood(root, x, len(b))
            if given:
                ll = ll - N.log_likelihood(root, {c: v for c, v in x.items() if c in given}, len(b))
            return pd.DataFrame({keep: b[keep], "ll": ll})

        return self._map(rows.select(keep, *[c for c in scope if c in rows.columns]), fn, f"{keep} long, ll double")

    def complete(self, rows: DataFrame, keep: str, seed: int | None = None) -> DataFrame:
        """Null cells filled: a most probable completion, or with seed, draws (the same for the same row)."""
        scope = list(self.root.scope)

        def fn(root: N.Node, b: pd.DataFrame) -> pd.DataFrame:
            x = {c: b[c].to_numpy(float) for c in scope}
            if seed is None:
                out = N.complete(root, x, len(b))
            else:
                each = [N.complete(root, {c: v[i : i + 1] for c, v in x.items()}, 1, np.random.default_rng([seed, int(b[keep].iloc[i]) & 0x7FFFFFFF])) for i in range(len(b))]
                out = {c: np.concatenate([e[c] for e in each]) for c in scope}
            return pd.DataFrame({keep: b[keep], **out})

        return self._map(rows.select(keep, *scope), fn, ", ".join([f"{keep} long", *(f"{c} double" for c in scope)]))

    def gradients(self, rows: DataFrame, keep: str) -> DataFrame:
        scope = list(self.root.scope)

        def fn(root: N.Node, b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({keep: b[keep], **N.feature_gradients(root, {c: b[c].to_numpy(float) for c in scope}, len(b))})

        return self._map(rows.select(keep, *scope), fn, ", ".join([f"{keep} long", *(f"{c} double" for c in scope)]))

    def em(self, rows: DataFrame, iterations: int = 5) -> Model:
        """Sum weights, and parameters of Gaussian and Bernoulli leaves, by expectation maximisation: one pass over rows for each iteration;
        each batch sends a few numbers per node."""
        scope, root = list(self.root.scope), N.copy(self.root)
        N.assign_ids(root)
        for _ in range(iterations):
            def fn(r: N.Node, b: pd.DataFrame) -> pd.DataFrame:
                sums = N.em_step_sums(r, {c: b[c].to_numpy(float) for c in scope}, len(b))
                return pd.DataFrame([(i, k, float(v)) for i, s in sums.items() for k, v in enumerate(s)], columns=["node", "child", "n"])

            got = Model(root, self.rows, self.spark)._map(rows.select(*scope), fn, "node int, child int, n double").groupBy("node", "child").agg(F.sum("n").alias("n")).collect()  # one row per edge of a sum
            new = {(r.node, r.child): r.n for r in got}
            for node in root.walk():
                if isinstance(node, N.Sum):
                    w = np.array([new.get((node.id, k), 0.0) for k in range(len(node.children))]) + np.exp(-100)
                    node.weights = w / w.sum()
                elif isinstance(node, N.Leaf) and node.fits:
                    node.em_update(np.array([new.get((node.id, k), 0.0) for k in range(3)]))
        return Model(root, self.rows, self.spark)

    def marginal(self, keep: list[str]) -> Model:
        return Model(N.assign_ids(N.marginalize(self.root, keep)), self.rows, self.spark)

    def given(self, **evidence: float) -> tuple[Model | None, float]:
        root, ll = N.condition(self.root, evidence)
        return (Model(root, round(self.rows * np.exp(ll)), self.spark) if root is not None else None), ll

    def save(self, path: str) -> None:
        """Tables under path: nodes (id, kind, scope, parameters), edges, bins of leaves, cells of joint leaves."""
        N.assign_ids(self.root)
        nodes, edges, bins, cells = [], [], [], []
        for n in self.root.walk():
            nodes.append((n.id, n.kind, list(n.scope), float(getattr(n, "rows", 0.0)), float(getattr(n, "non_null", 1.0)), bool(getattr(n, "discrete", True)), list(getattr(n, "condition", [])), self.rows, _text(n)))
            for k, c in enumerate(n.children):
                box = [(a, float(lo), float(hi)) for a, (lo, hi) in n.boxes[k].items()] if isinstance(n, N.Split) else []
                centre = [float(v) for v in n.centres[k]] if isinstance(n, N.Sum) and n.centres else []
                edges.append((n.id, k, c.id, float(n.weights[k]) if isinstance(n, N.Sum | N.Split) else 1.0, box, centre))
            if type(n) is N.Leaf:
                bins += [(n.id, i, *map(float, v)) for i, v in enumerate(zip(n.lo, n.hi, n.value, n.pdf, strict=True))]
            if isinstance(n, N.Joint):
                cells += [(n.id, a.tolist(), b.tolist(), float(p)) for a, b, p in zip(n.low, n.high, n.pdf, strict=True)]
        for name, data, schema in (("nodes", nodes, _NODES), ("edges", edges, _EDGES), ("bins", bins, _BINS), ("cells", cells, _CELLS)):
            self.spark.createDataFrame(data, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        read = lambda name, *order: spark.read.parquet(f"{path}/{name}").orderBy(*order).collect()  # noqa: E731  as many rows as the model has parts
        made: dict[int, N.Node] = {}
        bins, cells = {}, {}
        for r in read("bins", "id", "bin"):
            bins.setdefault(r.id, []).append(r)
        for r in read("cells", "id"):
            cells.setdefault(r.id, []).append(r)
        rows = 0
        for r in read("nodes", "id"):
            rows = r.table_rows
            if r.text is not None:
                made[r.id] = from_text(r.text)
            elif r.kind == "leaf":
                b = bins.get(r.id, [])
                made[r.id] = N.Leaf(list(r.scope), lo=[x.lo for x in b], hi=[x.hi for x in b], pdf=[x.pdf for x in b], non_null=r.non_null, rows=r.rows, discrete=r.discrete)
                made[r.id].value = np.array([x.value for x in b])
            elif r.kind == "joint":
                c = cells.get(r.id, [])
                made[r.id] = N.Joint(list(r.scope), low=np.array([x.low for x in c]).reshape(len(c), len(r.scope)), high=np.array([x.high for x in c]).reshape(len(c), len(r.scope)), pdf=[x.pdf for x in c], rows=r.rows)
            else:
                kind = {"sum": N.Sum, "product": N.Product, "factorize": N.Factorize, "split": N.Split}[r.kind]
                made[r.id] = kind(list(r.scope))
                if r.kind == "factorize":
                    made[r.id].condition = list(r.condition)
                if r.kind in ("sum", "split"):
                    made[r.id].rows, made[r.id].weights = r.rows, np.zeros(0)
            made[r.id].id = r.id
        for e in read("edges", "id", "position"):
            p = made[e.id]
            p.children.append(made[e.child])
            if isinstance(p, N.Sum | N.Split):
                p.weights = np.r_[p.weights, e.weight]
            if isinstance(p, N.Split):
                p.boxes.append({b.column: (b.lo, b.hi) for b in e.box})
            if isinstance(p, N.Sum) and e.centre:
                p.centres = [*(p.centres or []), np.array(e.centre)]
        return cls(made[0], rows, spark)


_NODES = "id int, kind string, scope array<string>, rows double, non_null double, discrete boolean, condition array<string>, table_rows long, text string"
_EDGES = "id int, position int, child int, weight double, box array<struct<column:string,lo:double,hi:double>>, centre array<double>"
_BINS = "id int, bin int, lo double, hi double, value double, pdf double"
_CELLS = "id int, low array<double>, high array<double>, pdf double"


def _text(n: N.Node) -> str | None:
    """The whole of a node of another kind than those that the tables hold."""
    return None if type(n) in (N.Leaf, N.Joint, N.Sum, N.Product, N.Factorize, N.Split) else as_text(n)


def _bounds(b: pd.DataFrame, scope: list[str]) -> tuple[N.Batch, N.Batch]:
    lo = {c: b[f"{c}_lo"].to_numpy(float, na_value=np.nan) for c in scope if f"{c}_lo" in b}
    hi = {c: b[f"{c}_hi"].to_numpy(float, na_value=np.nan) for c in scope if f"{c}_hi" in b}
    either = lo.keys() | hi.keys()
    m = len(b)
    unbounded = lambda d, c, v: np.where(np.isnan(d[c]), v, d[c]) if c in d else np.full(m, v)
    free = {c for c in either if bool(np.isnan(lo.get(c, np.full(m, np.nan))).all() and np.isnan(hi.get(c, np.full(m, np.nan))).all())}
    return {c: unbounded(lo, c, -np.inf) for c in either - free}, {c: unbounded(hi, c, np.inf) for c in either - free}


def q_errors(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, cardinality, truth, q_error) with max(est, true) / min(est, true), both at least 1."""
    e, t = F.greatest("cardinality", F.lit(1.0)), F.greatest(F.col("truth").cast("double"), F.lit(1.0))
    return estimates.join(truth, "query_id").select("query_id", "cardinality", "truth", (F.greatest(e, t) / F.least(e, t)).alias("q_error"))


def error_percentiles(errors: DataFrame) -> DataFrame:
    """(p50, p90, p95, p99, worst) of a workload's q-errors: one row for each query."""
    at = F.percentile("q_error", F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    return errors.agg(at.alias("p"), F.max("q_error").alias("worst")).select(*[F.col("p")[i].alias(f"p{n}") for i, n in enumerate((50, 90, 95, 99))], "worst")
