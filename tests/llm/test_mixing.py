import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetloom.llm import mixing, queries

from .helpers import corpus, frame, words


def fill(budget, children):
    """children: {name: (weight, supply)}; real-valued shares by raising one common level."""
    shares, left, open_ = {}, float(budget), dict(children)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = {n: s for n, (w, s) in open_.items() if w == 0 or s <= left * w / weight + 1e-9} if weight else {n: 0 for n in open_}
        if not full:
            return shares | {n: left * w / weight for n, (w, _) in open_.items()}
        name = min(full, key=lambda n: (full[n] / open_[n][0] if open_[n][0] else 0, n))
        shares[name] = full[name]
        left -= full[name]
        del open_[name]
    return shares


def brute(leaves, weights, budget):
    """Real-valued budgets of {path: supply}."""
    found = {}

    def descend(prefix, budget):
        depth = len(prefix)
        names = sorted({p[depth] for p in leaves if p[:depth] == prefix})
        supply = {n: sum(s for p, s in leaves.items() if p[: depth + 1] == (*prefix, n)) for n in names}
        shares = fill(budget, {n: (weights[depth](n), supply[n]) for n in names})
        for n in names:
            if depth == 2:
                found[*prefix, n] = shares[n]
            else:
                descend((*prefix, n), shares[n])

    descend((), budget)
    return found


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    draw = random.Random(seed)
    leaves = {(d, lang, s): draw.choice([0, 3, 50, 1000, 20_000]) for d in "ab" for lang in "xyz" for s in "pqrs" if draw.random() < 0.8}
    total = sum(leaves.values())
    table = spark.createDataFrame([(*map("={}".format, p), t) for p, t in leaves.items()], "d string, l string, s string, tokens long")
    part = draw.choice([0.1, 0.5, 1.5, 9])
    columns = [F.when(mixing.level_is("d", "a"), 3).otherwise(1), F.when(mixing.level_is("l", "x"), 0).otherwise(2), F.lit(1)]
    got = {(r.d[1:], r.l[1:], r.s[1:]): r.budget for r in mixing.budgets(table, ["d", "l", "s"], columns, F.col("tokens") * part, 2).collect()}
    supply = {p: 0 if p[1] == "x" else 2 * t for p, t in leaves.items()}
    budget = min(int(total * part), sum(supply.values()))
    wanted = brute(supply, [lambda n: 3 if n == "a" else 1, lambda n: 0 if n == "x" else 2, lambda n: 1], budget)
    assert got.keys() == wanted.keys()
    assert sum(got.values()) == budget
    assert all(got[p] <= supply[p] and abs(got[p] - wanted[p]) < 3.1 for p in got)


def test_prefixes_of_seeded_epochs(spark):
    rows = corpus()
    docs = frame(spark, rows)
    found = mixing.mix(docs, ["lang", "source"], [F.lit(1), F.when(mixing.level_is("source", "src0"), 5).otherwise(1)], F.col("tokens") * 1.5, 3, seed=7)
    taken = found.collect()
    assert len(taken) == len(rows)
    leaves = {}
    for r in taken:
        leaves.setdefault((r.lang, r.source), []).append(r)
    for mine in leaves.values():
        budget, epochs = mine[0].leaf_budget, mine[0].whole_epochs
        assert sum(r.n_tokens * r.whole_epochs + r.part_tokens for r in mine) == budget
        key = lambda r: hashlib.md5(f"7/{epochs}/{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        order = sorted(mine, key=key)
        shown = [r.part_tokens == r.n_tokens for r in order if r.n_tokens]
        assert shown == sorted(shown, reverse=True)
    again = mixing.mix(docs.repartition(5), ["lang", "source"], [F.lit(1), F.when(mixing.level_is("source", "src0"), 5).otherwise(1)], F.col("tokens") * 1.5, 3, seed=7)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, taken))
    assert sorted(r.n_tokens for r in taken) == sorted(len(words(t)) for _, t in rows)


def test_rows_kept_by_one_pass(spark):
    docs = frame(spark, corpus())
    kept = mixing.keep_mixed(docs, ["lang", "source"], [F.lit(1), F.lit(1)], F.col("tokens") / 2)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert mixing.keep_mixed(docs, ["lang", "source"], [F.lit(1), F.lit(1)], F.col("tokens")).where("text <> ''").count() == docs.where("n_chars > 0 AND trim(BOTH ' \n\t' FROM text) <> ''").count()


def test_null_levels_and_empty(spark):
    rows = [(1, "a b c", None, "s", 5), (2, "a b", "", "s", 3), (3, "c d e f", "en", None, 7), (4, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in mixing.mix(docs, ["lang", "source"], [F.lit(1), F.lit(1)], F.col("tokens")).collect()}
    assert len(found) == 4 and found[1].lang is None and found[2].lang == "" and found[3].source is None
    assert mixing.mix(docs.limit(0), ["lang", "source"], [F.lit(1), F.lit(1)], F.col("tokens")).count() == 0


def test_query_spends_the_budget(spark, tables):
    found = queries.op10_mixing(spark, tables)
    total, taken = found.selectExpr("sum(n_tokens)", "sum(n_tokens * whole_epochs + part_tokens)").first()
    assert taken == total // 2
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
