"""M6: a queue of forest settings with a stop rule, and an ensemble by forward selection.

Each candidate's folds grow in one pass (``forest.fit``); its score is the exact
ROC-AUC of the out-of-fold probabilities. After ``patience`` candidates without a
gain the queue stops. The ensemble starts from the best candidate and takes, step
by step, the one whose probability raises the AUC of the mean most (a candidate
may be taken again and then counts twice), until none does; all additions of a
step are scored in one grouped sweep.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import curves, forest


@dataclass
class Selected:
    leaderboard: DataFrame  # candidate, cv_auc, times (how often the ensemble holds it); best first
    ensemble: list[int]
    auc: float
    forests: dict[int, forest.Forest]  # the ensemble's candidates, refitted on all rows

    def score(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """``df`` with the ensemble's mean probability."""
        names = {i: f"_p{i}" for i in self.forests}
        both = forest.scored(df, [self.forests[i] for i in names], list(names.values()))
        return both.withColumn(out, sum(F.col(names[i]) for i in self.ensemble) / len(self.ensemble)).drop(*names.values())


def out_of_fold(df: DataFrame, features, label: str, keys, settings: forest.Settings, fold: str, folds: int, out: str, bins: int = 32,
                ready: forest.Prepared | None = None) -> DataFrame:
    """``df`` with the probability that a forest gives each row without having seen its fold."""
    grown = forest.fit(df, features, label, keys, [replace(settings, without_fold=k) for k in range(folds)], bins, fold, ready=ready)
    names = [f"_f{k}" for k in range(folds)]
    scores = forest.scored(df, [grown.only(k) for k in range(folds)], names)
    return scores.withColumn(out, F.element_at(F.array(*names), F.col(fold).cast("int") + 1)).drop(*names)


def run_queue(df: DataFrame, features, label: str, keys, candidates: list[forest.Settings], fold: str = "fold", folds: int = 5,
              patience: int = 10, bins: int = 32) -> Selected:
    """Work off ``candidates`` in their order on rows with a ``fold`` in 0 ... folds - 1 (others, and rows without a
    label, are left out). Ties go to the earlier candidate. Without both classes every AUC counts as 0."""
    rows = df.filter(F.col(label).isin(0, 1) & F.col(fold).between(0, folds - 1)).select(*keys, label, fold, *features)
    rows, aucs, best = cut_lineage(rows), [], None
    ready = forest.prepared(rows, features, label, keys, candidates[0].seed, bins, fold)  # binned once for all candidates and refits
    for i, settings in enumerate(candidates):
        rows = cut_lineage(out_of_fold(rows, features, label, keys, settings, fold, folds, f"p{i}", bins, ready))
        aucs.append(curves.roc_auc(rows, label, f"p{i}").first()["roc_auc"] or 0.0)
        best = i if best is None or aucs[i] > aucs[best] else best
        if i - best >= patience:
            break
    ensemble, auc = [best], aucs[best]
    while True:
        mean = lambda i: (sum(F.col(f"p{j}") for j in ensemble) + F.col(f"p{i}")) / (len(ensemble) + 1)
        options = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), mean(i).alias("prob")) for i in range(len(aucs))]))
        long = rows.select(F.col(label).alias("y"), options.alias("o")).select("y", "o.*")
        found = {r["model"]: r["roc_auc"] or 0.0 for r in curves.roc_auc(long, by=["model"]).collect()}  # a row for each candidate
        i = max(found, key=lambda m: (found[m], -m))
        if found[i] <= auc:
            break
        ensemble, auc = [*ensemble, i], found[i]
    board = [(i, float(a), ensemble.count(i)) for i, a in enumerate(aucs)]
    leaderboard = df.sparkSession.createDataFrame(board, "candidate int, cv_auc double, times int").orderBy(F.desc("cv_auc"), "candidate")
    refitted = {i: forest.fit(rows, features, label, keys, candidates[i], bins, fold, ready=ready) for i in sorted(set(ensemble))}
    return Selected(leaderboard, ensemble, auc, refitted)
