import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairforge.functions import numeric, text
from pairforge.operators import block, clusters, features, graph, metrics, ml, profile, queues, review, signals, split, vectors
from pairforge.sources import checks, io


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text_functions(spark):
    one = lambda f, *xs: values(spark, f(F.col("x")), [(x,) for x in xs])
    assert one(text.collapse_space, " a　 b\n", None) == ["a b", None]
    assert one(text.soft_alias, "Shop-King (97%)", None) == ["shopking", ""]
    assert one(text.signature, "Big SALE!! now", "你好, 世界! ÄB㐀") == ["big sale now", "你好世界b"]
    assert one(lambda x: text.clipped(x, 8), "abcdefgh", "abcd  fghij") == ["abcdefgh", "abcd..."]
    assert one(text.short_fingerprint, "0x" + "ab" * 20, "12") == ["0x" + "AB" * 8, ""]
    assert one(text.id_list, "3, 1;3 x9") == [[3, 1, 9]]
    assert one(text.url_key, "https://WWW.Ex.com/a//b/c?q#f", "no url") == ["ex.com/a/b", None]
    assert one(text.first_number, "ab 1,234.5", "-3,5 kg", "+7", "none", "2.50.1") == [1.234, -3.5, 7.0, None, 2.5]
    assert one(text.first_whole, "1,9", "-1,9", "") == [1, -1, None]
    assert one(text.hours, "在线 48 小时", "12.7 h", "x") == [48, 12, None]
    assert [r and tuple(r) for r in one(text.good_and_risk, "9:3", "好∶ 12 ∶ 4", "9")] == [(9, 3), (12, 4), None]
    style = spark.createDataFrame([("Ab 1!", "é²\nX")], "t string, d string").select(text.style(F.col("t"), F.col("d")).alias("s")).first().s
    # visible: A b 1 ! é ² X; letters: A b é X
    assert (style.title_length, style.description_length, style.digits, style.punctuation, style.upper, style.line_ends) == (5, 4, round(1 / 7, 6), round(1 / 7, 6), 0.5, 1)
    assert one(text.words, "The cat and a dog2") == [["cat", "dog2"]]
    assert one(lambda x: text.char_grams(x, 2), "abc", "a") == [["ab", "bc"], []]
    assert one(text.visible_text, "<p>a<script>x</script>b</p><!-- c -->") == ["a b"]
    assert one(text.truthy, "Yes", "0", None) == [True, False, False]
    assert one(text.nfkc, "ＡＢ") == ["AB"]
    assert one(text.unescaped, "a &amp; b") == ["a & b"]
    assert one(text.casefolded, " Straße ") == ["strasse"]
    assert one(text.listed, "a|| b||||c") == [["a", "b", "c"]]


def test_segments_and_contacts(spark):
    got = values(spark, text.sentences(F.col("x"), 20), [("One. Two!\nthis is long, it has a comma",)])
    assert got == [["One.", "Two!", "this is long", "it has a comma"]]
    got = values(spark, text.contacts(F.col("x")), [("mail A.b@x.org or wickr: joe_1 -----BEGIN KEY-----a@b.cc-----END KEY-----",)])
    assert {(r["kind"], r["raw"]) for r in got[0]} == {("email", "A.b@x.org"), ("wickr", "wickr: joe_1")}


def test_aliases(spark):
    rows = [("king-shop", "KingShop (9%)"), ("kingshop", "kingshap"), ("alphabeta", "xalphabez"), ("ab", "cd"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(text.aliases_related(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False]
    assert [r[0] for r in df.select(text.common_run("a", "b")).collect()] == [3, 6, 7, 0, 0]
    assert df.select(text.pair_key(F.col("a"), F.col("b"))).first()[0] == df.select(text.pair_key(F.col("b"), F.col("a"))).first()[0]


def test_numeric(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [1]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(numeric.jaccard(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 3, 0, 0])
    row = spark.range(1).select(
        numeric.structural_support(F.lit(0.6), F.lit(0.2), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("three"),
        numeric.structural_support(F.lit(0.6), F.lit(0.2), F.lit(0.4), F.lit(0.8)).alias("four"),
        numeric.style_consistency([F.lit(0.2), F.lit(None).cast("double"), F.lit(0.9)]).alias("style"),
        numeric.closeness(F.lit(0.0), F.lit(1.0)).alias("none"),
        numeric.sigmoid(numeric.logit(F.lit(0.3))).alias("p"),
    ).first()
    assert row["three"] == pytest.approx(1.5 / 3) and row["four"] == pytest.approx(2.7 / 4)
    assert row["style"] == pytest.approx(0.8) and row["none"] is None and row["p"] == pytest.approx(0.3)


def test_reliability_and_rank_score(spark):
    names = "fingerprints contacts description_clone description_idf title_clone title_idf rare_ngrams support category style boilerplate_ratio boilerplate_count semantic".split()
    rows = [
        (1.0, 0.0, True, 2.5, True, 1.0, 3.0, 0.6, 0.0, 0.8, 0.0, 0.0, 0.9),  # 0.2 + 0.45 + 0.15 + 0.08 + 0.12 + 0.08
        (0.0, 0.0, False, 0.0, False, 0.0, 0.0, 0.1, 0.1, 0.1, 0.8, 0.0, 0.8),  # 0.2 - 0.2 - 0.25, not below 0
        (None, 1.0, None, None, None, None, None, None, None, None, None, 3.0, 0.99),  # 0.2 + 0.35 - 0.2
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'boolean' if n.endswith('clone') else 'double'}" for n in names))
    got = [r.r for r in df.select(numeric.reliability(**{n: F.col(n) for n in names}).alias("r")).collect()]
    assert [r.score for r in got] == [1.0, 0.0, 0.35] and [(r.direct, r.topic_only) for r in got] == [(True, False), (False, True), (True, False)]
    assert got[0].components == ["+shared_pgp_fingerprint:0.450", "+rare_description_clone:0.150", "+rare_ngram_support:0.080", "+structural_support:0.120", "+style_consistency:0.080"]
    assert got[1].components == ["-0.200:boilerplate_template_penalty", "-0.250:semantic_topic_only_penalty"]
    score = spark.range(1).select(numeric.rank_score(*(F.lit(x) for x in (1, 2, 0, 5, 0.5, 0.25)), F.lit(True))).first()[0]
    assert score == 6 + 5 + 2 * 3 + 3 + 0.5 - 0.5


def test_top_values_and_signatures_break_ties_differently(spark):
    items = spark.createDataFrame([("e", v, i) for i, v in enumerate("abab cd")], "e string, v string, i int")
    counts = profile.value_counts(items, ["e"], "v", "i")
    assert [r.value for r in profile.top_values(counts, ["e"], 3).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.value for r in profile.signature_values(counts, ["e"], F.lit(1), 3).orderBy("rank").collect()] == ["b", "a", "d"]


def test_blocking_drops_hot_values(spark):
    rows = [(i, "hot") for i in range(10)] + [(1, "x"), (2, "x"), (2, "x"), (3, "y")]
    got = block.pairs_by_value(spark.createDataFrame(rows, "id int, value string"), most=5).collect()
    assert [(r.left, r.right, r.value, r.group_size) for r in got] == [(1, 2, "x", 2)]


def test_percentile_uses_the_greatest_rank_of_ties(spark):
    rows = [("p", "m", v) for v in (1.0, 2.0, 2.0, None)] + [("p", "n", 5.0)]
    df = spark.createDataFrame(rows, "pool string, market string, v double")
    got = {(r.market, r.v): r.q for r in features.market_percentile(df, "v", ["pool"], ["market"], "q", least=3).collect()}
    assert got == {("m", 1.0): 0.0, ("m", 2.0): 1.0, ("m", None): None, ("n", 5.0): 1.0}
    alone = spark.createDataFrame([("p", "m", 3.0)], "pool string, market string, v double")
    assert features.market_percentile(alone, "v", ["pool"], ["market"], "q").first().q == 0.5


def random_graph(seed, n=40, m=45):
    rng = random.Random(seed)
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def components_of(edges):
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_whatever_the_order(spark, seed):
    edges = random_graph(seed)
    flipped = [(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(reversed(edges))]
    want = components_of(edges)
    for e in (edges, flipped):
        got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(e, "a int, b int")).collect()}
        assert got == want


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert set(got.values()) == {0, 1000, 5000} and len(got) == 201 + 300 + 1


def pruned(edges, least):
    while True:
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        kept = [(a, b) for a, b in edges if len(near[a] & near[b]) >= least]
        if len(kept) == len(edges):
            return sorted(kept)
        edges = kept


def test_pruning(spark):
    k4 = [(a, b) for a, b in itertools.combinations(range(4), 2)]
    for edges, least in ((k4 + [(3, 4)], 1), (k4 + [(10, 11), (11, 12)], 2), (random_graph(3, 12, 40), 2)):
        df = spark.createDataFrame([(a, b, 0.5) for a, b in edges], "a int, b int, score double")
        assert sorted((r.a, r.b) for r in graph.prune_by_neighbours(df, least).collect()) == pruned(edges, least)
    df = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.2)], "a int, b int, score double")
    assert [(r.a, r.b) for r in graph.prune_by_neighbours(df, 1, keep_score=0.8).collect()] == [(0, 1)]


def test_reciprocal_needs_both_sides(spark):
    df = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.7)], "a int, b int, score double")
    assert sorted((r.a, r.b) for r in graph.reciprocal(df, 1).collect()) == [(1, 2)]


def test_closure_of_cyclic_facts(spark):
    facts = [("f", "a"), ("f", "b"), ("g", "b"), ("g", "c"), ("h", "c"), ("h", "a"), ("i", "z")]
    got = graph.closure(spark.createDataFrame(facts, "fact string, key string"), spark.createDataFrame([("a",)], "key string"))
    assert {r.key: r.round for r in got.collect()} == {"a": 0, "b": 1, "c": 1}


def test_conflicting_components_and_closure_pairs(spark):
    pos = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9)], "a int, b int")
    neg = spark.createDataFrame([(1, 3)], "a int, b int")
    members = graph.consistent_components(pos, neg)
    assert {r.id for r in members.collect()} == {7, 8, 9}
    assert [(r.a, r.b) for r in graph.closure_pairs(members, pos, 5).collect()] == [(7, 9)]


def test_closure_pairs_against_all_pairs(spark):
    rng = random.Random(6)
    members = [(i, i % 3) for i in range(60)] + [(100, 100)]
    known = [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == b % 3 and (a < 3 or rng.random() < 0.6)] + [(1, 2), (5, 100)]
    got = graph.closure_pairs(spark.createDataFrame(members, "id int, component int"), spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in known], "a int, b int"), 7).collect()
    for c in range(3):
        want = [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 == c == b % 3 and (a, b) not in set(known)][:7]
        assert sorted((r.a, r.b) for r in got if r.component == c) == want


def test_auc_and_average_precision_with_ties(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0.1, 0.3, 0.5, 0.9]), rng.randint(0, 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, score double, label int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(df, []).first().auc == pytest.approx(want, abs=1e-6)
    hit, total = 0, 0.0
    for k, (_, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        hit += y
        total += y * hit / k
    assert metrics.average_precision(df, [], "score", "label", "id").first().average_precision == pytest.approx(total / len(pos), abs=1e-6)
    assert metrics.roc_auc(df.filter("label = 1"), []).first().auc is None


def test_exclusive_p90(spark):
    import statistics

    ten, nine = list(range(1, 11)), [5, 3, 9, 1, 2, 8, 7, 4, 6]
    df = spark.createDataFrame([(ten,), (nine,), ([],)], "x array<int>")
    got = [r[0] for r in df.select(metrics.exclusive_p90(F.col("x"))).collect()]
    assert got[0] == pytest.approx(statistics.quantiles(ten, n=10)[8]) and got[1] == 9 and got[2] is None


def test_bootstrap_is_seeded_and_skips_single_class_samples(spark):
    rows = [(f"g{i % 6}", i / 40, int(i % 6 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    draw = lambda: sorted(map(tuple, metrics.bootstrap(df.repartition(3), "g", "score", "label", resamples=60, seed=3).collect()))
    one = draw()
    assert one == draw() and len(one) == 60
    valid = metrics.interval(metrics.bootstrap(df, "g", "score", "label", resamples=60, seed=3), "auc").first().valid
    assert valid == sum(r[3] is not None for r in one) < 60


def test_logistic_with_offset_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    off = rng.normal(size=200) * 0.3
    y = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 0.5 * x[:, 1] + off)))).astype(int)
    rows = [(float(a), float(b) if i % 9 else None, float(o), int(t)) for i, ((a, b), o, t) in enumerate(zip(x, off, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, o double, y int").cache()
    model = ml.fit_logistic(df, ["a", "b"], "y", offset="o", l2=1.0)
    b = np.array([np.nan if r[1] is None else r[1] for r in rows])
    b = np.where(np.isnan(b), np.nanmean(b), b)
    z = np.stack([x[:, 0], b], 1)
    z = np.column_stack([np.ones(200), (z - z.mean(0)) / z.std(0)])
    theta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ theta + off)))
        ridge = np.diag([0.0, 1, 1])
        theta -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - y) + ridge @ theta)
    assert [model.intercept, *model.coefficients] == pytest.approx(theta.tolist(), abs=1e-6)
    assert ml.Scorer.from_json(model.to_json()) == model


def test_platt_reaches_the_minimum(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0.05, 0.95, 150)
    y = (rng.random(150) < p**2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int").cache()
    fitted = ml.fit_platt(df, "p", "y")
    z, n = np.log(p / (1 - p)), y.sum()
    t = np.where(y == 1, (n + 1) / (n + 2), 1 / (150 - n + 2))
    slope = 1 / (1 + np.exp(-(z * fitted.scale + fitted.bias))) - t
    assert abs((slope * z).sum() + 1e-3 * (fitted.scale - 1)) < 1e-5 and abs(slope.sum() + 1e-3 * fitted.bias) < 1e-5


def test_trees_and_collapse_guard(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 3), int(i % 10 > 4)) for i in range(80)], "a double, b double, y int")
    scored = ml.tree_scores(ml.fit_trees(df, ["a", "b"], "y", rounds=3, depth=2), df, ["a", "b"])
    assert scored.filter((F.col("prob_positive") > 0.5) != (F.col("y") == 1)).isEmpty()
    assert ml.is_collapsed(df.withColumn("p", F.lit(0.5)), "p") and not ml.is_collapsed(df, "a")
    assert ml.family_gains({"x": 3.0, "y": 1.0}, {"f": ["x"], "g": ["x", "y"]}) == {"f": 0.75, "g": 0.25, "other": 0.0}


def components(spark, rows):
    """(component, label, stratum) rows as a component table."""
    return split.component_table(spark.createDataFrame(rows, "component string, label string, stratum string"), "component", "label", "stratum")


def test_split_keeps_components_whole_and_balances_strata(spark):
    rows = [(str(i), "positive" if (i + j) % 3 == 0 else "negative", f"s{i % 2}") for i in range(60) for j in range(1 + i % 4)]
    ratios = {"train": 0.55, "valid": 0.2, "test": 0.25}
    got = {r.component: r.split for r in split.split_components(components(spark, rows), ratios).collect()}
    assert len(got) == 60
    for name, want in ratios.items():
        for kind in (None, ("positive", "s0"), ("negative", "s1")):
            own = [r for r in rows if kind is None or r[1:] == kind]
            assert sum(got[c] == name for c, *_ in own) / len(own) == pytest.approx(want, abs=0.08), (name, kind)


def test_split_seeds_rare_kinds(spark):
    rows = [(f"c{i}", "negative", "common") for i in range(20)] + [("r1", "positive", "rare"), ("r2", "positive", "rare"), ("r2", "negative", "common"), ("r3", "positive", "rare"), ("only", "positive", "single")]
    need = [{"label": "positive", "stratum": "rare", "splits": ["train", "valid", "test"], "severity": "error", "least_in_pool": 3}, {"label": "positive", "stratum": "single", "splits": ["valid"], "least_in_pool": 2}]
    got = {r.component: r.split for r in split.split_components(components(spark, rows), {"train": 0.6, "valid": 0.2, "test": 0.2}, requirements=need).collect()}
    # the smallest components first, by name: r1 and r3 have one row, r2 two
    assert (got["r1"], got["r3"], got["r2"]) == ("train", "valid", "test")
    with pytest.raises(ValueError, match="more than 3"):
        split.split_components(components(spark, rows), {"a": 1.0}, most_components=3)


def test_boundary_quotas():
    assert split.boundary_quotas(100, 60, 40, 0.2, 0.35, 0.35) == (7, 7, 6)
    assert split.boundary_quotas(10, 0, 10, 0.5, 0.35, 0.35) == (0, 2, 3)
    assert split.boundary_quotas(3, 2, 1, 0.3, 0.9, 0.9) == (0, 1, 0)
    assert split.boundary_quotas(5, 3, 2, 0.01, 0.35, 0.35) == (0, 1, 0)


def test_running_sums_whatever_the_ranges(spark):
    rng = random.Random(8)
    rows = [(g, round(x, 4), rng.randrange(5)) for g in ("a", "b", None) for x in {rng.gauss(0, 1) for _ in range(300)}] + [("one", 1.0, 2)]
    got = metrics.running(spark.createDataFrame(rows, "g string, x double, n bigint").groupBy("g", "x").agg(F.sum("n").alias("n")), ["g"], "x", ["n"], ranges=5).collect()
    for r in got:
        assert r.before_n == sum(n for g, x, n in rows if g == r.g and x < r.x)


def test_thresholds_by_resamples(spark):
    rng = random.Random(2)
    rows = [(min(1.0, max(0.0, round(rng.gauss(0.4 + 0.2 * y, 0.15), 3))), y) for y in (0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "s double, y int")
    found = metrics.bootstrap_threshold(df, "s", "y", "balanced_accuracy")
    assert found["used"] and 0.35 < found["threshold"] < 0.65 and found["distinct"] >= 3
    alone = metrics.bootstrap_threshold(df, "s", "y", "balanced_accuracy", resamples=1)
    assert alone["reason"] == "few_thresholds"
    assert alone["threshold"] == metrics.best_threshold(metrics.threshold_scan(df, "s", "y"), "balanced_accuracy").first().threshold
    assert metrics.bootstrap_threshold(df.filter("y = 1"), "s", "y", "f1")["reason"] == "one_label"


def test_signals_of_all_kinds():
    found = lambda text: [(k, v, e, facing, risk, direct) for k, v, _, e, _, facing, risk, direct, _ in signals.signals_of(text)]
    assert found("联系 飞机号：@shop_one 微信：good_shop9 QQ 12345678") == [
        ("telegram", "shop_one", "telegram_cue", 1, 0, 1), ("wechat", "good_shop9", "wechat_cue", 1, 0, 1), ("qq", "12345678", "qq_cue", 1, 0, 1),
    ]
    assert found("@nobody_here in the text") == [] and found("contact @some_body now")[0][:3] == ("telegram", "some_body", "telegram_at_handle_with_context")
    assert found("PGP fingerprint: AAAA BBBB CCCC DDDD EEEE 1111 2222 3333 4444 5555")[0][:2] == ("pgp_fingerprint", "aaaabbbbccccddddeeee11112222333344445555")
    assert found("see http://www.shop.onion/viewtopic, http://Good.Shop.com/a//b/c?x=1, youtube.com/x")[0][:2] == ("external_url", "good.shop.com/a/b") and len(found("youtube.com/x t.me")) == 0
    assert [f[:2] for f in found("jabber: Joe.X@xmpp.org 蝙蝠 id 1234567")] == [("email", "joe.x@xmpp.org"), ("jabber", "joe.x@xmpp.org"), ("bat", "1234567")]
    assert found("leak sample a@b.org") == [("email", "a@b.org", "plain_email", 0, 1, 0)] and found("a..b@c.org") == []
    assert found("USDT 钱包 T" + "A" * 33)[0] == ("crypto_wallet", "T" + "A" * 33, "crypto_wallet", 1, 0, 1)
    block = "-----BEGIN PGP PUBLIC KEY BLOCK-----\nx@y.org\n-----END PGP PUBLIC KEY BLOCK-----"
    assert [f[0] for f in found(f"{block} wickr me: Fast_Shop")] == ["pgp_public_key", "wickr"] and found("Ｑ Ｑ：１２３４５６")[0][:2] == ("qq", "123456")
    assert found("tel 电话：+86 138-0013-8000 and again 手机 8613800138000") == [("phone", "8613800138000", "phone_cue", 1, 0, 1)]
    assert signals.in_context("phone", "138 0013", "call 1-380-013") and not signals.in_context("qq", "12", "1 2") and signals.in_context("qq", "aB", "xab")


def test_signal_queues(spark):
    rows = [("s1", "qq", "123", 1, 0, 0), ("s2", "qq", "123", 1, 0, 0), ("s3", "qq", "123", 1, 1, 0), ("s1", "email", "a@b", 1, 0, 0), ("s2", "email", "a@b", 1, 0, 0), ("s4", "url", "u", 0, 0, 1)]
    df = spark.createDataFrame(rows, "entity string, kind string, value string, direct int, risk int, support_only int")
    good = queues.eligible_signals(df, ["qq", "email"], {"*": ["none"], "email": ["A@B "]})
    assert [tuple(r) for r in queues.signal_pairs(good).collect()] == [("s1", "s2", "qq", "123", 2)]
    index, left_out = signals.signal_index(df, ["qq", "email"], {"email": ["a@b"]})
    assert {r.entity: r.contacts for r in index.collect()} == {"s1": ["qq:123"], "s2": ["qq:123"]} and {r.reason: r.signals for r in left_out.collect()} == {"risk": 1, "excluded_value": 2, "kind": 1}


def test_capped_order_and_routes(spark):
    df = spark.createDataFrame([(i, f"t{i % 2}", f"b{i % 3}", 10.0 - i) for i in range(9)], "k int, token string, bucket string, score double")
    got = [(r.k, r["rank"]) for r in queues.capped_in_order(df, [F.desc("score")], "k", {"token": 2, "bucket": 1}, 9).collect()]
    assert got == [(0, 1), (1, 2), (2, 3)]
    with pytest.raises(PySparkException, match="too few"):
        queues.capped_in_order(df, [F.desc("score")], "k", {"token": 1}, 5, candidates=4).collect()
    edges = spark.createDataFrame([(True, False, "x", 3, None), (False, False, "text_clone_primary", 3, "negative")], "contact boolean, fingerprint boolean, stratum string, cluster_rank int, review_label string")
    assert [(r.target_bucket, r.suggested_label, r.route) for r in queues.routed(edges, {"template_clone": {"target_bucket": "own"}}).collect()] == [("cluster_0003_identifier_anchor", "positive_candidate", "queue"), ("own", "uncertain_candidate", "rereview")]
    assert queues.threshold_token(0.735) == "0735000" and queues.ratio_token(0.5) == "050"


def test_clusters(spark):
    labels = spark.createDataFrame([("positive", True, 1, "", ""), ("positive", False, 1, "qq:1", ""), ("positive", True, 0, "QQ:1", ""), ("positive", True, 0, "email:a", "good"), ("positive", True, 0, "email:a", "good bad"), ("", None, None, None, None), (None,) * 5], "l string, u boolean, f int, v string, n string")
    got = [r[0] for r in labels.select(clusters.label_class(*(F.col(c) for c in "lufvn"), ("qq:",), ("good",), ("bad",))).collect()]
    assert got == ["proof_positive", "nonproof_positive", "proof_positive", "proof_positive", "nonproof_positive", "blank", "missing"]
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.4), (7, 8, 0.9)], "a int, b int, score double")
    members = graph.connected_components(edges)
    assert clusters.graph_agrees(edges, members, {"edges": 3, "nodes": 5, "clusters": 2}) == [] and clusters.graph_agrees(edges, members, {"edges": 2, "nodes": 5, "clusters": 3}) == ["edges", "clusters"]
    assert clusters.run_overlap(edges, edges.limit(0), ["a", "b"]).first().jaccard == 0.0


def test_contexts_of_sources(spark):
    df = spark.createDataFrame([((1, "x"), 2)], "a struct<b: int, c: string>, d int")
    assert checks.missing_fields(df, {"one": "a.b", "two": "a.z", "three": "d", "four": "e.f"}) == ["two", "four"]
    assert checks.acceptance({"x": True, "y": False}) == {"x": True, "y": False, "all_passed": False, "failed": ["y"]}


def test_capped_greedy(spark):
    pairs = [(1, 2, 9.0), (1, 3, 8.0), (1, 4, 7.0), (3, 4, 6.0), (2, 3, 5.0)]
    df = spark.createDataFrame(pairs, "left int, right int, score double")
    got = [(r.left, r.right) for r in split.capped_greedy(df, [F.desc("score")], most=3, each=2).orderBy("rank").collect()]
    assert got == [(1, 2), (1, 3), (3, 4)]
    with pytest.raises(Exception, match="too few"):
        split.capped_greedy(df, [F.desc("score")], most=5, each=1, candidates=2).collect()


def test_mixup_stays_between(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "k int, v array<double>")
    rows = split.mixup(df, "k", "v", k=2, most_each=1).collect()
    assert len(rows) == 5
    for r in rows:
        assert 0.2 <= r.share <= 0.8 and r.vector[0] == pytest.approx(r.share * r.left + (1 - r.share) * r.right)
    # each row's two nearest
    assert all(abs(r.left - r.right) <= 2 for r in rows)


def test_nearest_vectors_in_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5).round(1)], int(rng.integers(2))) for i in range(60)] + [(60, [0.0] * 5, 0), (61, None, 0), (None, [1.0] * 5, 0)]
    rows += [(70 + i, rows[0][1], rows[0][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, g int")
    for metric in ("cosine", "distance"):
        got = {}
        for r in vectors.nearest(df, "id", "v", 3, by="g", metric=metric).collect():
            got.setdefault(r.src, []).append((r["rank"], r.dst))
        for i, v, g in rows:
            if i is None or v is None:
                continue
            one = np.array(v)
            scores = []
            for j, w, h in rows:
                if j not in (None, i) and w is not None and h == g:
                    other = np.array(w)
                    n = np.linalg.norm(one) * np.linalg.norm(other)
                    scores.append((-round((one @ other / n if n else 0.0) if metric == "cosine" else -((one - other) ** 2).sum(), 9), j))
            assert [d for _, d in sorted(got[i])] == [j for _, j in sorted(scores)[:3]]


def test_recall_of_reciprocal_edges(spark):
    """All true reciprocal edges of a label's vectors are found, and no others."""
    from pairforge.plans import graph_queries

    sf = "/root/testdata/sf0.01"
    own = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    unit = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in own}
    best = {}
    for r in own:
        others = [(-round(float(unit[r.vec_id] @ unit[o.vec_id]), 6), o.vec_id) for o in own if o.label == r.label and o.vec_id != r.vec_id]
        best[r.vec_id] = {j for _, j in sorted(others)[:4]}
    want = {(i, j) for i, top in best.items() for j in top if i < j and i in best[j]}
    got = {(r.a, r.b) for r in graph_queries.reciprocal_topk_edges(spark, sf).collect()}
    assert got == want and len(want) > 500


def test_masking(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(400)], "k int, f double, w double")
    share = split.mask_columns(df, F.col("k") < 200, ["f"], 0.5, "k").filter("f = 0").count()
    assert 70 < share < 130
    assert split.masked_copies(df, F.col("k") < 10, ["f"], "w", 0.5).filter("f is null and w = 0.5").count() == 10


@pytest.mark.parametrize(("missing", "overwrite"), [("insert", False), ("skip", True)])
def test_upsert_policies(spark, missing, overwrite):
    old = spark.createDataFrame([(1, "a", "n1"), (2, None, "n2"), (3, "", "n3")], "k int, label string, note string")
    new = spark.createDataFrame([(1, "z", ""), (2, "b", None), (9, "c", "n9")], "k int, label string, note string")
    got = {r.k: (r.label, r.note, r.action) for r in review.upsert(old, new, "k", ["label", "note"], "label", missing=missing, overwrite=overwrite).collect()}
    want = {1: ("z", "n1", "updated") if overwrite else ("a", "n1", "kept_labelled"), 2: ("b", "n2", "updated"), 3: ("", "n3", "unchanged")}
    assert got == want | {9: ("c", "n9", "inserted") if missing == "insert" else (None, None, "skipped")}
    with pytest.raises(ValueError, match="not in the queue"):
        review.upsert(old, new, "k", ["label"], "label", missing="error")


def test_queue_takes_strata_in_turn(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)] + [("c", i) for i in range(2)], "s string, i int")
    got = [(r.s, r.i) for r in review.balanced_queue(df, "s", [F.col("i")]).orderBy("queue_rank").collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2)]


def test_cluster_decisions(spark):
    # edges, proof, identifiers, contacts, fingerprints, titles, descriptions, text strata, semantic strata
    rows = [(4, 4, 4, 4, 0, 0, 0, 0, 0), (4, 2, 2, 2, 0, 4, 0, 0, 0), (4, 1, 1, 1, 0, 0, 0, 0, 0), (4, 0, 1, 0, 0, 4, 0, 0, 0), (4, 0, 0, 0, 1, 4, 0, 0, 0), (4, 0, 0, 0, 0, 1, 2, 0, 4), (4, 0, 0, 0, 0, 1, 1, 1, 2), (4, 0, 0, 0, 0, 1, 1, 1, 1), (0,) * 9]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in "abcdefghi"))
    got = [r[0] for r in df.select(review.cluster_decision(*(F.col(c) for c in "abcdefghi"))).collect()]
    assert [g.decision for g in got] == [
        "same_controller_high_confidence", "same_controller_core_with_possible_expansion", "partial_anchor", "uncertain", "uncertain", "template_clone_not_controller", "semantic_topic_not_controller", "uncertain", "uncertain",
    ]
    assert [g.confidence for g in got][:3] == ["high", "high", "medium"] and got[3].use == "manual_review_before_claim"


def test_strata_priorities_and_thresholds(spark):
    rows = [(True, 1, 1, 1, 1, 1.0, 1.0), (False, 1, 0, 1, 0, 0.0, 0.0), (False, 0, 0, 0, 1, 0.5, 0.9), (False, 0, 1, 0, 0, 0.5, 0.9), (False, 0, 0, 0, 0, 0.1, 0.5), (False, 0, 0, 0, 0, 0.1, 0.4), (False, 0, 0, 0, 0, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "a boolean, b int, c int, d int, e int, f double, g double")
    assert [r[0] for r in df.select(review.evidence_stratum(*(F.col(c) for c in "abcdefg"))).collect()] == [
        "same_alias_continuity", "identifier_plus_text", "text_clone_primary", "identifier_primary", "semantic_structural", "semantic_only", "semantic_only",
    ]
    scan = spark.createDataFrame([(0.2, 5, 3, 2, 0), (0.5, 5, 1, 4, 0), (0.6, 4, 0, 5, 1), (0.9, 0, 0, 5, 5)], "threshold double, tp bigint, fp bigint, tn bigint, fn bigint")
    # 0.5 and 0.6 have the same accuracy; 0.6 has the greater specificity
    assert metrics.best_threshold(scan, "accuracy").first().threshold == 0.6
    assert metrics.best_threshold(scan, "recall").first().threshold == 0.5
    # nobody is predicted positive at 0.9; of those within the drop the guard takes the greatest f1
    assert metrics.best_threshold(scan, "specificity", least_positive=1).first().threshold == 0.6
    assert metrics.best_threshold(scan, "specificity", least_positive=5, most_drop=0.2).first().threshold == 0.5
    assert metrics.best_threshold(scan, "specificity", least_positive=5, most_drop=0.1).first().threshold == 0.6


def test_csv_json_and_dump_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'say "x"', ["1"]), ("", None, [])], "x string, y string, z array<string>")
    io.write_csv(df.coalesce(1), str(tmp_path / "c"), ["x", "y", "z", "w"], tolerant=True)
    back = io.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["x", "y", "z", "w"] and back.filter(F.col("x") == "a\nb").first().y == 'say "x"'
    with pytest.raises(ValueError, match="columns"):
        io.write_csv(df, str(tmp_path / "d"), ["x"])
    io.write_json_lines(df, str(tmp_path / "j"))
    assert io.read_json_lines(spark, str(tmp_path / "j"), df.schema).count() == 2
    (tmp_path / "dump.sql").write_text("INSERT INTO `t` (`id`, `name`) VALUES\n(1, 'o''k'),\n(2, 'b');\nnoise\n")
    rows = io.read_sql_dump(spark, str(tmp_path / "dump.sql"), r"^\((\d+), '((?:[^']|'')*)'\)", [("id", "int"), ("name", "string")]).collect()
    assert [tuple(r) for r in rows] == [(1, "o'k"), (2, "b")]
    assert io.insert_columns(spark, str(tmp_path / "dump.sql")) == ["id", "name"]


def test_result_files_and_lookups(spark, tmp_path):
    from pairforge.sources import results

    (tmp_path / "c.json").write_text('{"a": {"x": 2}, "b": [1]}')
    assert results.load_config(str(tmp_path / "c.json"), {"a": {"x": 1, "y": 3}, "c": 4}) == {"a": {"x": 2, "y": 3}, "b": [1], "c": 4}
    results.write_json({"k": "é"}, str(tmp_path / "o.json"))
    assert (tmp_path / "o.json").read_text(encoding="utf-8") == '{\n  "k": "é"\n}\n'
    assert results.resolved_features({"v": ["a", "b"], "w": ["b", "c"]}, ["w", "v"], ["d"], ["c"]) == ["b", "a", "d"]
    with pytest.raises(KeyError):
        results.resolved_features({}, ["v"])
    assert results.allowed_name("step_a", ["step"], []) and not results.allowed_name("step_a", [], ["step_"]) and not results.allowed_name("x", ["step"], [])
    manifest = spark.createDataFrame([("s", 1, "strict"), ("s", 2, "excluded"), ("t", 1, "aux")], "source string, row int, data_bucket string")
    raw = spark.createDataFrame([("s", 1, "A"), ("s", 2, "B"), ("t", 1, "C"), ("u", 1, "D")], "source string, row int, title string")
    got = results.with_raw_rows(results.eligible_lookup(manifest, ["strict", "aux"], ["source", "row"]), raw, "source", "row")
    assert sorted(map(tuple, got.collect())) == [("s", 1, "strict", "A"), ("t", 1, "aux", "C")]
    with pytest.raises(checks.CheckFailed):
        results.eligible_lookup(manifest.union(manifest), ["strict"], ["source", "row"])
    pairs = spark.createDataFrame([(" K ", "1"), ("k", "0"), ("k", " "), ("", "2")], "a string, f string")
    assert [tuple(r) for r in results.multimap(pairs, "a", "f").collect()] == [("k", ["0", "1"])]
    scores = spark.createDataFrame([("p", "0.5"), ("q", ""), ("r", "NaN")], "uid string, s string")
    assert [tuple(r) for r in results.score_map(scores, "uid", "s").collect()] == [("p", 0.5)]
    with pytest.raises(checks.CheckFailed):
        results.score_map(scores, "uid", "none")
    assert results.run_scores({"a": scores.limit(1), "b": scores.limit(1)}, "uid", "s").count() == 2
    assert results.found_summaries(str(tmp_path), "*.json")[-1].endswith("o.json") and results.found_summaries(str(tmp_path / "no"), "*.json", str(tmp_path))
    one = results.context_fingerprint([str(tmp_path / "c.json"), str(tmp_path / "gone")])
    assert one == results.context_fingerprint([str(tmp_path / "gone"), str(tmp_path / "c.json")]) != results.context_fingerprint([str(tmp_path / "c.json")])
    assert results.merged_summary({"context": 1, "runs": {"a": 1}}, {"context": 1, "runs": {"b": 2}}) == ({"context": 1, "runs": {"a": 1, "b": 2}}, False)
    assert results.merged_summary({"context": 1}, {"context": 2}) == ({"context": 2}, True) and results.merged_summary(None, {"context": 2})[1] is False
    runs = [{"family": "f", "run": "a", "auc": 0.7}, {"family": "f", "run": "b", "auc": 0.8}, {"family": "f", "run": "c", "auc": 0.8, "average_precision": 0.1}]
    assert results.resolved_scorer(runs, "f")["run"] == "c" and results.resolved_scorer(runs, "f", "a")["run"] == "a"
    assert results.missing_inputs({"x": str(tmp_path / "c.json"), "y": str(tmp_path / "gone")}, ["json", "no_such_module"]) == ["y", "no_such_module"]
    assert results.grid(ratio=[1, 2], seed=[7]) == [{"ratio": 1, "seed": 7}, {"ratio": 2, "seed": 7}]
    old, new = spark.createDataFrame([(1, 0.1, "x"), (2, 0.2, "y")], "k int, s double, t string"), spark.createDataFrame([(1, 0.9, 5), (3, 0.3, 6)], "k int, s double, u int")
    assert sorted(map(tuple, results.merged_columns(old, new, "k", ["s", "u"]).collect())) == [(1, 0.9, "x", 5), (2, 0.2, "y", None)]
    kept, left_out = results.core_eligible(spark.createDataFrame([("1",), ("0",), (None,)], "u string"), "u")
    assert kept.count() == 1 and left_out == 2
    assert [tuple(r) for r in results.read_config_table(spark, [{"a": "x"}, {"b": 2}], "a string, b int").collect()] == [("x", None), (None, 2)]


def test_sinks_and_broken_lines(spark, tmp_path):
    one, two = spark.createDataFrame([(1, ["x"])], "a int, b array<string>"), spark.createDataFrame([("z", 2)], "c string, a int")
    assert io.write_union_csv([one, two], str(tmp_path / "u")) == ["a", "b", "c"]
    assert sorted(tuple(r) for r in io.read_csv(spark, str(tmp_path / "u")).collect()) == [("1", '["x"]', None), ("2", None, "z")]
    rows = spark.createDataFrame([(f"b{i % 2}", (i * 7) % 50) for i in range(50)], "bucket string, n int")
    io.write_sorted_buckets(rows, str(tmp_path / "s"), "bucket", ["n"])
    for b in ("b0", "b1"):
        lines = [int(x) for f in sorted((tmp_path / "s" / f"bucket={b}").glob("part-*")) for x in f.read_text().split()[1:]]
        assert lines == sorted(lines) and len(lines) == 25
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_text("<p>one\ntwo</p>\n")
    assert [tuple(r) for r in io.read_pages(spark, str(tmp_path / "h" / "*.html")).collect()] == [("a.html", "<p>one\ntwo</p>\n")]
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    io.need_json_lines(spark, str(tmp_path / "good.jsonl"))
    with pytest.raises(io.BrokenLine, match="bad.jsonl, line 3"):
        io.need_json_lines(spark, str(tmp_path / "bad.jsonl"))
    vectors_ = spark.createDataFrame([(1, [0.5])], "id int, v array<double>")
    assert io.write_vectors(vectors_, str(tmp_path / "v"), "id") == io.table_fingerprint(vectors_, ["id"])
    assert io.read_vectors(spark, str(tmp_path / "v"), vectors_, "id").count() == 1 and io.read_vectors(spark, str(tmp_path / "v"), vectors_.limit(0), "id") is None


def test_worksheet_source(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="B2"><v>7</v></c></row></sheetData></worksheet>'
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
    from pairforge.shared import ship

    ship(spark)
    spark.dataSource.register(io.WorksheetSource)
    rows = spark.read.format("worksheet").option("path", str(path)).load()
    assert rows.columns == ["name", "n"] and [tuple(r) for r in rows.collect()] == [(None, "7")]


def test_checks(spark):
    df = spark.createDataFrame([("k1", "a", 1.0), ("k2", "b", None), ("k1", "b", None)], "k string, s string, v double")
    with pytest.raises(checks.CheckFailed):
        checks.need_unique(df, "k")
    with pytest.raises(checks.CheckFailed):
        checks.need_columns(df, ["k", "nope"])
    with pytest.raises(checks.CheckFailed):
        checks.need_no_overlap(df, "s", "k")
    with pytest.raises(checks.CheckFailed):
        checks.need_values(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"])
    with pytest.raises(checks.CheckFailed):
        checks.need_references(df, "k", spark.createDataFrame([("k1",)], "id string"), "id")
    assert [tuple(r) for r in checks.overlaps(df, "s", "k").collect()] == [("a", "b", 1)]
    assert checks.sorted_thresholds([0.5, 0.1, 0.5]) == [0.1, 0.5]
    assert io.table_fingerprint(df) == io.table_fingerprint(df.repartition(3)) != io.table_fingerprint(df.limit(1))


def test_streaming_counters_equal_batch(spark, tmp_path):
    from pairforge.streaming import counters

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = counters.windowed_counters(counters.event_stream(spark, str(tmp_path / "in"), events.schema, 10), late="4000 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("w"), "event_type").count().count()
    assert spark.table("counted").count() == want and spark.table("counted").agg(F.sum("events")).first()[0] == events.count()


def test_rules(spark):
    from pairforge.operators import rules

    df = spark.createDataFrame([(1, "ab", 0.5), (2, None, 0.9), (3, "xb", None)], "k int, s string, v double")
    assert [r.k for r in df.filter(rules.condition({"v": {"min": 0.5}, "s": {"starts": ["a", "c"]}})).collect()] == [1]
    assert [r.k for r in df.orderBy(*rules.ordering(["~0.8:v", "k"])).collect()] == [2, 1, 3]
    got = [r.d.label for r in df.select(rules.decided([(F.col("v") > 0.6, "yes", "high")], ("no", "else")).alias("d")).collect()]
    assert got == ["no", "yes", "no"]
    assert [r[0] for r in df.select(rules.issues({"s": F.col("s") == "ab", "v": F.col("v") < 0.8})).collect()] == [[], ["s", "v"], ["s", "v"]]
    assert rules.resolved_thresholds(df, "v", [0.4, 0.95], [0.5], 1) == [0.4] and rules.resolved_thresholds(df, "v", [0.95], [0.5], 1) == [0.7]
    assert rules.guarded({"depth": 5, "rounds": 90}, 30, [(100, {"depth": 3}), (20, {"rounds": 10})]) == {"depth": 3, "rounds": 90}
    assert [r.k for r in rules.best_appearance(df.withColumn("g", F.lit(1)), "g", ["-v"]).collect()] == [2]


def test_files(tmp_path):
    from pairforge.sources import files

    for name in ("a.csv", "b.csv", "c.csv"):
        (tmp_path / name).write_text(name)
    (tmp_path / "s.json").write_text('{"x": ["out/a.csv", {"y": "b.csv"}], "n": 3}')
    keep = files.referenced([str(tmp_path / "s.json")])
    assert keep == {"a.csv", "b.csv"}
    assert files.archive_unreferenced(str(tmp_path), "*.csv", keep, str(tmp_path / "old")) == ["c.csv"] and (tmp_path / "c.csv").exists()
    files.archive_unreferenced(str(tmp_path), "*.csv", keep, str(tmp_path / "old"), dry_run=False)
    assert (tmp_path / "old" / "c.csv").exists() and files.newest(str(tmp_path), "*.csv") is not None and files.newest(str(tmp_path), "*.x", "f") == "f"
    saved = files.snapshot([str(tmp_path / "a.csv")], str(tmp_path / "snap"))
    assert files.sha256_of(saved + "/a.csv") in (tmp_path / "snap" / "manifest.json").read_text()
    assert files.backup(str(tmp_path / "a.csv")).endswith(".bak") and files.backup(str(tmp_path / "no")) is None


def test_exact_quantiles_of_uneven_groups(spark):
    rng = random.Random(3)
    rows = [("big", rng.choice([0.0, 1.0, rng.random()])) for _ in range(900)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 7.0), ("none", None)]
    got = {(r.g, r.point): r.quantile for r in metrics.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.3, 0.5, 1.0], ranges=8).collect()}
    for group in ("big", "one", "two", None):
        own = np.array([v for g, v in rows if g == group])
        assert [got[group, p] for p in (0.0, 0.3, 0.5, 1.0)] == pytest.approx(np.quantile(own, [0.0, 0.3, 0.5, 1.0]).tolist())
    assert len(got) == 16
    every = metrics.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", [0.5]).first().quantile
    assert every == pytest.approx(float(np.quantile([v for _, v in rows if v is not None], 0.5)))
