"""Structural causal models whose equations are Column expressions, so worlds are projections.

An equation takes a function from name to Column and returns a Column; exogenous noise is a column
of the input. do() replaces equations, and a counterfactual keeps a row's noise: for additive
equations the noise is what the observed value leaves over.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infocausal.operators.dependence import Gram
from infocausal.operators.quantiles import percentiles

Equation = Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Model:
    """Equations in causal order. `additive` ones have their noise column u_<name> added by the model."""

    equations: dict[str, Equation]
    additive: bool = True
    fixed: dict[str, Column] = field(default_factory=dict)

    def do(self, **values) -> Model:
        return Model(self.equations, self.additive, {**self.fixed, **{k: F.lit(v) if not isinstance(v, Column) else v for k, v in values.items()}})

    def columns(self, noise: Callable[[str], Column]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for name, eq in self.equations.items():
            if name in self.fixed:
                out[name] = self.fixed[name]
            else:
                out[name] = eq(out.__getitem__) + noise(name) if self.additive else eq(out.__getitem__)
        return out

    def simulate(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """df with the model's variables, from its noise columns u_<name>."""
        made = self.columns(lambda n: F.col(f"u_{n}"))
        return df.select("*", *[c.alias(n + suffix) for n, c in made.items()])

    def abduct(self, df: DataFrame) -> DataFrame:
        """df with noise columns u_<name> from its observed variables (additive models)."""
        return df.select("*", *[(F.col(n) - eq(F.col)).alias(f"u_{n}") for n, eq in self.equations.items()])

    def counterfactual(self, df: DataFrame, **values) -> DataFrame:
        """The observed rows with every variable's value had `values` been set: columns <name>_cf."""
        return self.do(**values).simulate(self.abduct(df), "_cf")


def linear(**terms: dict[str, float]) -> Model:
    """linear(m={"t": 1}, y={"t": 2, "m": 1.5}): sums of coefficients times parents; "1" is the intercept."""

    def equation(parts: dict[str, float]) -> Equation:
        def eq(v: Callable[[str], Column]) -> Column:
            out = F.lit(float(parts.get("1", 0.0)))
            for name, b in parts.items():
                if name != "1":
                    out = out + b * v(name)
            return out

        return eq

    return Model({name: equation(parts) for name, parts in terms.items()})


def fitted(df: DataFrame, parents: dict[str, list[str]]) -> Model:
    """The linear model of a causal order whose slopes and intercepts least squares finds; the moments of all variables come from one scan."""
    gram, terms = Gram(df, list(parents)), {}
    for name, ps in parents.items():
        slopes, intercept, _ = gram.ols(name, ps)
        terms[name] = {"1": intercept, **{p: float(b) for p, b in zip(ps, slopes, strict=True)}}
    return linear(**terms)


def worlds(model: Model, df: DataFrame, y: str, settings: dict[str, dict], evidence: Column | None = None) -> DataFrame:
    """world, n, mean, sd, low, middle, high (5th, 50th and 95th percentile), change (mean against what is observed), better (share of rows above their observed value).

    The rows that meet the evidence keep their own noise in every world, so worlds differ by their
    settings only: with evidence on the treatment, the change is the effect on those treated.
    """
    rows = model.abduct(df if evidence is None else df.filter(evidence))
    for i, values in enumerate(settings.values()):
        made = model.do(**values).columns(lambda n: F.col(f"u_{n}"))
        rows = rows.withColumn(f"_w{i}", made[y])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("world"), F.col(f"_w{i}").alias("v")) for i, n in enumerate(settings)]))
    x = rows.select(F.col(y).alias("_y"), each.alias("_x")).select("_y", "_x.*")
    v = F.col("v")
    s = x.groupBy("world").agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
        F.avg(v - F.col("_y")).alias("change"), F.avg((v > F.col("_y")).cast("double")).alias("better"),
    )
    marks = percentiles(x, "world", "v", [0.05, 0.5, 0.95])
    marks = df.sparkSession.createDataFrame([(w, *q) for w, q in marks.items()], "world string, low double, middle double, high double")
    return s.join(F.broadcast(marks), "world", "left").select("world", "n", "mean", "sd", "low", "middle", "high", "change", "better")  # marks: a row a world


def unit_bounds(df: DataFrame, y1: str, y0: str) -> DataFrame:
    """Shares of units by their pair of potential outcomes: always, never, helped, hurt."""
    a, b = F.col(y1).cast("boolean"), F.col(y0).cast("boolean")
    share = lambda c: F.avg(c.cast("double"))
    return df.agg(share(a & b).alias("always"), share(~a & ~b).alias("never"), share(a & ~b).alias("helped"), share(~a & b).alias("hurt"))
