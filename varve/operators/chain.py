"""Steps that learn from one table and apply to others: fit, transform and, where the step can be undone, inverse.

A step's fit is one aggregate job over the training rows; its state is a small dictionary of numbers, so a fitted chain can be saved as JSON and
its transforms are projections that Catalyst folds into the scan's stage.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import nan_to_null, safe_corr
from ..functions.quantiles import column_percentiles
from . import features, select, wrapper
from .series import Series


class Step:
    """A step over columns; NaN and infinities are missing values. Subclasses give `learn` (state per column from the training rows), `forward` and, if they can be undone, `backward`."""

    def __init__(self, columns: Sequence[str]):
        self.columns, self.state = list(columns), None

    def learn(self, df: DataFrame) -> dict[str, dict]:
        return {c: {} for c in self.columns}

    def forward(self, x: Column, s: dict) -> Column:
        raise NotImplementedError

    def backward(self, x: Column, s: dict) -> Column:
        raise NotImplementedError(f"{type(self).__name__} can't be undone")

    def fit(self, df: DataFrame) -> Step:
        self.state = self.learn(df)
        return self

    def _need(self) -> dict[str, dict]:
        if self.state is None:
            raise ValueError(f"{type(self).__name__} is not fitted")
        return self.state

    def transform(self, df: DataFrame) -> DataFrame:
        state = self._need()
        return df.withColumns({c: self.forward(nan_to_null(c), state[c]) for c in self.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        state = self._need()
        return df.withColumns({c: self.backward(F.col(c), state[c]) for c in self.columns})


def _row(df: DataFrame, columns: Sequence[str], **aggregates) -> dict[str, dict]:
    row = df.agg(*(F.struct(*(f(nan_to_null(c)).cast("double").alias(k) for k, f in aggregates.items())).alias(c) for c in columns)).first()
    return {c: row[c].asDict() for c in columns}


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(nan_to_null(c).alias(c) for c in columns))


class Impute(Step):
    """Missing values by the training mean or median. Undoing leaves the filled values."""

    def __init__(self, columns: Sequence[str], by: str = "mean"):
        super().__init__(columns)
        self.by = by

    def learn(self, df):
        if self.by == "mean":
            return _row(df, self.columns, fill=F.avg)
        row = column_percentiles(_clean(df, self.columns), self.columns, [0.5]).first()
        return {c: {"fill": row[c][0] if row[c] else None} for c in self.columns}

    def forward(self, x, s):
        return F.coalesce(x, F.lit(s["fill"]))

    def backward(self, x, s):
        return x


class Clip(Step):
    """Values held within the quartiles less and plus k interquartile ranges. Undoing leaves the clipped values."""

    def __init__(self, columns: Sequence[str], k: float = 3.0):
        super().__init__(columns)
        self.k = k

    def learn(self, df):
        row = column_percentiles(_clean(df, self.columns), self.columns, [0.25, 0.75]).first()
        out = {}
        for c in self.columns:
            a, b = row[c] or (None, None)
            out[c] = {"low": None, "high": None} if a is None else {"low": a - self.k * (b - a), "high": b + self.k * (b - a)}
        return out

    def forward(self, x, s):
        return F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(s["low"])), F.lit(s["high"])))

    def backward(self, x, s):
        return x


class Log(Step):
    """Logarithm of columns that are skewed (|skewness| > 1 or excess kurtosis > 5), lifted so that the training minimum is 1; below it, the value at it."""

    def learn(self, df):
        found = _row(df, self.columns, skew=F.skewness, excess=F.kurtosis, low=F.min)
        return {c: {"on": s["skew"] is not None and (abs(s["skew"]) > 1 or s["excess"] > 5), "lift": max(0.0, 1 - (s["low"] or 0.0))} for c, s in found.items()}

    def forward(self, x, s):
        return F.ln(F.greatest(x + s["lift"], F.lit(1e-12))) if s["on"] else x

    def backward(self, x, s):
        return F.exp(x) - s["lift"] if s["on"] else x


class Scale(Step):
    """Standard (population) or robust (median over the 5-95 range) scaling; constant columns become 0."""

    def __init__(self, columns: Sequence[str], how: str = "standard"):
        super().__init__(columns)
        self.how = how

    def learn(self, df):
        if self.how == "standard":
            return {c: {"at": s["m"] or 0.0, "by": s["s"] or 0.0} for c, s in _row(df, self.columns, m=F.avg, s=F.stddev_pop).items()}
        row = column_percentiles(_clean(df, self.columns), self.columns, [0.05, 0.5, 0.95]).first()
        return {c: {"at": row[c][1] if row[c] else 0.0, "by": row[c][2] - row[c][0] if row[c] else 0.0} for c in self.columns}

    def forward(self, x, s):
        return (x - s["at"]) / s["by"] if s["by"] else F.when(x.isNotNull(), F.lit(0.0))

    def backward(self, x, s):
        return x * s["by"] + s["at"]


class OneHot(Step):
    """Columns name_value of 0 and 1 for the most frequent values of a categorical column, at most `most`; the column itself goes. Can't be undone."""

    def __init__(self, columns: Sequence[str], most: int = 20):
        super().__init__(columns)
        self.most = most

    def learn(self, df):
        return {c: {"values": [r[0] for r in df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(self.most).collect()]} for c in self.columns}

    def transform(self, df):
        state = self._need()
        return df.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for c in self.columns for v in state[c]["values"]}).drop(*self.columns)


class Ordered(Step):
    """A step whose columns are read along series: keys spread them, order is total within a key."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str], order: Sequence[str]):
        super().__init__(columns)
        self.keys, self.order = list(keys), list(order)

    @property
    def series(self) -> Series:
        return Series(tuple(self.keys), tuple(self.order))


class Smooth(Ordered):
    """The mean of the present values among `width` rows (odd) around each row of a series; a row without any stays null. Undoing leaves the smoothed values."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], width: int = 3):
        super().__init__(columns, keys, order)
        if width < 1 or width % 2 == 0:
            raise ValueError("width must be odd")
        self.width = width

    def transform(self, df):
        self._need()
        w = self.series.rows(-(self.width // 2), self.width // 2)
        return df.withColumns({c: F.avg(nan_to_null(c)).over(w) for c in self.columns})

    def backward(self, x, s):
        return x


class Difference(Ordered):
    """A value less the one `lag` rows before. The first `lag` values of a series stand in name_start, null elsewhere, from which undoing sums up again.

    A null makes two differences null; undoing takes null differences as 0, so fill gaps first."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], lag: int = 1):
        super().__init__(columns, keys, order)
        if lag < 1:
            raise ValueError("lag must be at least 1")
        self.lag = lag

    def transform(self, df):
        self._need()
        s = self.series
        d = df.withColumn("_place", s.position())
        first = F.col("_place") < self.lag
        new = {f"{c}_start": F.when(first, nan_to_null(c)) for c in self.columns} | {c: nan_to_null(c) - F.lag(nan_to_null(c), self.lag).over(s.by) for c in self.columns}
        return d.withColumns(new).drop("_place")

    def inverse(self, df):
        self._need()
        d = df.withColumn("_turn", F.pmod(self.series.position(), F.lit(self.lag)))
        s = Series((*self.keys, "_turn"), tuple(self.order))
        back = {c: F.sum(F.coalesce(f"{c}_start", c, F.lit(0.0))).over(s.past) for c in self.columns}
        return d.withColumns(back).drop("_turn", *(f"{c}_start" for c in self.columns))


class Lags(Ordered):
    """Columns name_lag_k of the values k rows before; null where a series has none. Undoing drops them."""

    def __init__(self, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], lags: Sequence[int] = (1, 2, 3)):
        super().__init__(columns, keys, order)
        self.lags = list(lags)

    def transform(self, df):
        self._need()
        return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(self.series.by) for c in self.columns for k in self.lags})

    def inverse(self, df):
        self._need()
        return df.drop(*(f"{c}_lag_{k}" for c in self.columns for k in self.lags))


class TimeParts(Step):
    """Columns of a time stamp's parts, under name_part. Undoing drops them."""

    def _parts(self) -> dict[str, Column]:
        return {f"{c}_{k}": v for c in self.columns for k, v in features.handler_time_features(c).items()}

    def transform(self, df):
        self._need()
        return df.withColumns(self._parts())

    def inverse(self, df):
        self._need()
        return df.drop(*self._parts())


class Generate(Step):
    """Columns a_times_b and a_over_b of every pair, a before b; a ratio is null where b is 0. Undoing drops them."""

    def __init__(self, columns: Sequence[str], kinds: Sequence[str] = ("times", "over")):
        super().__init__(columns)
        if set(kinds) - {"times", "over"}:
            raise ValueError("kinds are times and over")
        self.kinds = list(kinds)

    def _made(self) -> dict[str, Column]:
        out = {}
        for a, b in features.pair_names(self.columns):
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            out |= {f"{a}_{k}_{b}": x * y if k == "times" else F.try_divide(x, y) for k in self.kinds}
        return out

    def transform(self, df):
        self._need()
        return df.withColumns(self._made())

    def inverse(self, df):
        self._need()
        return df.drop(*self._made())


class Transforms(Step):
    """Columns name_transform for the mathematical transforms that serve: of each column at most k, best first, whose gain exceeds `threshold`.

    gain: how much nearer to a normal shape than the column, 1 / (1 + |skewness| + |excess kurtosis| / 2), plus, with a numeric target, how much more |correlation| with it, each
    from -1 to 1. All candidates come from one aggregate. A transform that is undefined for over half of a column's values, or constant, is none. Undoing drops the columns."""

    def __init__(self, columns: Sequence[str], k: int = 1, threshold: float = 0.1, target: str | None = None):
        super().__init__(columns)
        self.k, self.threshold, self.target = k, threshold, target

    def learn(self, df):
        made = {(c, n): nan_to_null(v) for c in self.columns for n, v in {"": F.col(c).cast("double"), **{n: v for n, v in features.math_transforms(c).items()}}.items()}
        y = nan_to_null(self.target) if self.target else None
        told = [F.struct(F.count(v).alias("n"), nan_to_null(F.skewness(v)).alias("s"), nan_to_null(F.kurtosis(v)).alias("e"), (safe_corr(v, y) if self.target else F.lit(0.0)).alias("r"), F.stddev_pop(v).alias("d")) for v in made.values()]
        row = dict(zip(made, df.agg(F.array(*told)).first()[0], strict=True))
        state = {}
        for c in self.columns:
            score = {}
            for (b, name), m in row.items():
                if b == c and m.d and m.s is not None and m.e is not None and 2 * m.n >= row[c, ""].n:
                    score[name] = 1 / (1 + abs(m.s) + abs(m.e) / 2) + abs(m.r)
            gain = {n: v - score[""] for n, v in score.items() if n} if "" in score else {}
            state[c] = {"chosen": sorted((n for n, g in gain.items() if g > self.threshold), key=lambda n: (-gain[n], n))[: self.k], "gain": gain}
        return state

    def transform(self, df):
        state = self._need()
        return df.withColumns({f"{c}_{n}": features.math_transforms(c)[n] for c in self.columns for n in state[c]["chosen"]})

    def inverse(self, df):
        return df.drop(*(f"{c}_{n}" for c in self.columns for n in self._need()[c]["chosen"]))


class Selector(Step):
    """A step that keeps some of its columns. Columns of None are all numeric ones of the training table, but for `leave` and the target; what isn't one of its columns stays.

    Subclasses give `rank`: (kept, score per column). Can't be undone."""

    def __init__(self, columns: Sequence[str] | None = None, target: str | None = None, leave: Sequence[str] = ()):
        super().__init__(columns or ())
        self.columns = None if columns is None else list(columns)
        self.target, self.leave = target, list(leave)

    def rank(self, df: DataFrame, columns: list[str]) -> tuple[list[str], dict[str, float]]:
        raise NotImplementedError

    def learn(self, df):
        numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
        columns = [c for c in (numeric if self.columns is None else self.columns) if c not in self.leave and c != self.target]
        kept, scores = self.rank(df, columns) if columns else ([], {})
        return {"kept": kept, "left": [c for c in columns if c not in kept], "scores": scores}

    def transform(self, df):
        return df.drop(*self._need()["left"])

    def inverse(self, df):
        raise NotImplementedError(f"{type(self).__name__} can't be undone")

    @property
    def kept(self) -> list[str]:
        return self._need()["kept"]

    def top(self, n: int) -> list[str]:
        """The n best kept columns, ties by name."""
        scores = self._need()["scores"]
        return sorted(self.kept, key=lambda c: (-scores.get(c, 0.0), c))[:n]


class Prune(Selector):
    """Leaves out columns that depend on a preferred one by at least `threshold`, preferred by variance or, with a target, by dependence on it; ties: the earlier column.

    relation: |correlation|, or "information": mutual information of quantile bins over the smaller of both columns' entropies (0 to 1). At least `least` columns stay,
    the preferred ones of those left out first. All pairs come from one job."""

    def __init__(self, columns: Sequence[str] | None = None, threshold: float = 0.95, target: str | None = None, relation: str = "correlation", bins: int = 16, least: int = 1, leave: Sequence[str] = ()):
        super().__init__(columns, target, leave)
        if relation not in ("correlation", "information"):
            raise ValueError("relation is correlation or information")
        self.threshold, self.relation, self.bins, self.least = threshold, relation, bins, least

    def rank(self, df, columns):
        if self.target:
            told = select.relevance(df, columns, self.target, self.bins).collect()
            score = {r.feature: r.mi for r in told}
        else:
            score = df.agg(*(F.var_pop(F.col(c).cast("double")).alias(c) for c in columns)).first().asDict()
        score = {c: score.get(c) or 0.0 for c in columns}
        order = sorted(columns, key=lambda c: -score[c])
        kept = select.redundancy_pruned(select.dependence(df, columns, self.relation, self.bins), order, self.threshold) if len(columns) > 1 else order
        kept += [c for c in order if c not in kept][: max(0, self.least - len(kept))]
        return [c for c in columns if c in kept], score


class Choose(Selector):
    """The columns that serve a target. by: "information" (mutual information of at least `threshold`, in `folds` of the leave-one-fold-out samples' share `share`),
    "mrmr" (greedy, little redundancy), "shadows" (all-relevant against shuffled copies), "elimination" (least cross-validated error), or "auto": elimination up to
    `auto_most` columns and a numeric target, else information.

    At most k columns (None: all) by score; none at all if nothing serves, unless `least` asks for some. All but information need a numeric target."""

    def __init__(
        self, target: str, columns: Sequence[str] | None = None, by: str = "information", k: int | None = None, threshold: float = 0.01, folds: int = 0, share: float = 0.5,
        bins: int = 16, least: int = 0, auto_most: int = 12, leave: Sequence[str] = (), model: dict | None = None,
    ):
        super().__init__(columns, target, leave)
        if by not in ("auto", "information", "mrmr", "shadows", "elimination"):
            raise ValueError(f"no such way to choose: {by}")
        self.by, self.k, self.threshold, self.folds, self.share, self.bins, self.least, self.auto_most, self.model = by, k, threshold, folds, share, bins, least, auto_most, model or {}

    def way(self, df: DataFrame, columns: list[str]) -> str:
        if self.by != "auto":
            return self.by
        return "elimination" if len(columns) <= self.auto_most and dict(df.dtypes)[self.target] not in ("string", "boolean") else "information"

    def rank(self, df, columns):
        by = self.way(df, columns)
        if by == "shadows":
            told = wrapper.all_relevant(df, columns, self.target, **self.model).collect()
            score, good = {r.feature: r.importance for r in told}, [r.feature for r in told if r.decision == "accepted"]
        elif by == "elimination":
            told = wrapper.eliminated(df, columns, self.target, **self.model).orderBy("size").collect()
            score = {r.dropped: 1.0 / r.size for r in told}  # the column that goes last scores most
            size = next((r.size for r in told if r.best), 0)
            good = [r.dropped for r in told if r.size <= size]
        else:
            told = select.relevance(df, columns, self.target, self.bins, self.folds, self.threshold).collect()
            score = {r.feature: r.mi for r in told}
            good = [r.feature for r in told if (r.stable >= self.share if self.folds else r.mi >= self.threshold)]
            if by == "mrmr":
                good = select.mrmr(df, columns, self.target, self.k or len(columns), "information", bins=self.bins)
        order = sorted(columns, key=lambda c: (-score.get(c, 0.0), c))
        good = good if by == "mrmr" else [c for c in order if c in good][: self.k]
        good += [c for c in order if c not in good][: max(0, self.least - len(good))]
        return [c for c in columns if c in good], {c: float(score.get(c, 0.0)) for c in columns}


#: Steps by name, for saved chains; register_step adds to it.
STEPS: dict[str, type[Step]] = {s.__name__: s for s in (Impute, Clip, Log, Scale, OneHot, Smooth, Difference, Lags, TimeParts, Generate, Transforms, Prune, Choose)}


def register_step(step: type[Step]) -> type[Step]:
    STEPS[step.__name__] = step
    return step


class Chain:
    """Steps in order; each is fitted on what the ones before it give. Columns named in `exclude` are never touched: no step may name one, and selectors leave them."""

    def __init__(self, *steps: Step, exclude: Sequence[str] = ()):
        clash = {c for s in steps for c in s.columns or ()} & set(exclude)
        if clash:
            raise ValueError(f"excluded columns in a step: {sorted(clash)}")
        self.steps, self.exclude = list(steps), sorted(set(exclude))
        for s in steps:
            if isinstance(s, Selector):
                s.leave = sorted({*s.leave, *exclude})

    def fit(self, df: DataFrame) -> Chain:
        for s in self.steps:
            df = s.fit(df).transform(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def inverse(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            df = s.inverse(df)
        return df

    def to_json(self) -> str:
        steps = [{"step": type(s).__name__, "options": {k: v for k, v in vars(s).items() if k not in ("state",)}, "state": s.state} for s in self.steps]
        return json.dumps({"exclude": self.exclude, "steps": steps})

    @staticmethod
    def from_json(text: str) -> Chain:
        saved, steps = json.loads(text), []
        saved = {"exclude": (), "steps": saved} if isinstance(saved, list) else saved  # chains saved before they kept their exclusions
        for x in saved["steps"]:
            step = STEPS[x["step"]](**x["options"])
            step.state = x["state"]
            steps.append(step)
        return Chain(*steps, exclude=saved["exclude"])
