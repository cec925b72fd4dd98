"""Mention counting and alias rules against direct implementations of their definition."""
import random
import re

from pyspark.sql import functions as F

from civisight.functions.text import match_key
from civisight.operators import entities


def _expected(text, aliases):
    """Aliases in rank order; every regex hit that does not touch an accepted span counts."""
    flat, spans = match_key(text), []
    for alias in aliases:
        for hit in re.finditer(rf"(?<![a-z0-9]){re.escape(match_key(alias))}(?![a-z0-9])", flat):
            if all(hit.end() <= a or hit.start() >= b for a, b, _ in spans):
                spans.append((hit.start(), hit.end(), alias))
    return sorted(alias for _, _, alias in spans)


def test_mentions_against_regex(spark):
    rng = random.Random(3)
    words = ["Ana", "Sá", "Lima", "Neto", "de", "e", "x1"]
    people = {1: ["ana sa lima", "ana sa", "sa lima", "lima"], 2: ["lima neto", "ana sa", "neto"], 3: ["x1 x1"]}
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows = [(p, a, a, r + 1, len(a.split())) for p, names in people.items() for r, a in enumerate(names)]
    aliases = spark.createDataFrame(rows, "entity_id int, alias string, alias_key string, alias_rank int, n_tokens int")
    found = entities.accepted_mentions(entities.alias_hits(spark.createDataFrame(docs, "doc_id int, text string"), aliases))
    got = {}
    for r in found.collect():
        got.setdefault((r.doc_id, r.entity_id), []).append(r.alias)
    for doc, text in docs:
        for person in (1, 2):       # 3 overlaps itself, where a regex scan skips ahead
            assert sorted(got.get((doc, person), [])) == _expected(text, people[person]), (doc, person)


def test_alias_rules(spark):
    people = spark.createDataFrame([
        ("m1", "minister", "João da Silva Neto", "João Pedro da Silva Neto", ["Joãozinho"]),
        ("m2", "minister", "Maria Souza", "Maria Souza", []),
        ("d1", "deputy", "Carlos Lima Filho", "Carlos Lima Filho", ["Da Vila"]),
        ("d2", "deputy", "Carlos Lima", "Carlos Lima", ["Lima Filho"]),
        ("j1", "first", "Rosa Maria", "Rosa Maria Dias", []),
    ], "id string, kind string, name string, official_name string, aliases_source array<string>")
    rules = entities.AliasRules(pair_kinds=("minister",), first_name_kinds=("first",), strict_kinds=("deputy",), banned=("souza",), min_single_by_kind={"first": 4})
    table = {}
    for r in entities.alias_table(people, rules).orderBy("alias_rank").collect():
        table.setdefault(r.entity_id, []).append(r.alias_key)
    assert table["m1"][0] == "joao pedro da silva neto"
    assert {"joao da silva neto", "joao silva", "joao neto", "pedro silva", "silva neto", "joao pedro", "joaozinho"} <= set(table["m1"])
    assert "joao" not in table["m1"]                 # four letters, and no exception for its kind
    assert table["m2"] == ["maria souza"]            # souza is banned, maria occurs in two entities
    assert set(table["d1"]) == {"carlos lima filho"}  # no leading particle; 'lima filho' belongs to two
    assert set(table["d2"]) == {"carlos lima"}
    assert "rosa" in table["j1"]


def test_directory(spark):
    docs = spark.createDataFrame([(1, "Ana Sa e Ana Sa Lima"), (2, "ana sa lima. Ana Sá Lima"), (3, "sa")], "doc_id int, text string")
    aliases = spark.createDataFrame([(7, "Ana Sá Lima", "ana sa lima", 1, 3), (7, "Ana Sá", "ana sa", 2, 2)], "entity_id int, alias string, alias_key string, alias_rank int, n_tokens int")
    people = spark.createDataFrame([(7, "k", "Nome", "Nome Oficial")], "id int, kind string, name string, official_name string")
    mentions = entities.accepted_mentions(entities.alias_hits(docs, aliases))
    row = entities.entity_directory(mentions, people).first()
    assert (row.display_name, row.occurrences, row.docs) == ("Ana Sá Lima", 4, 2)
    counts = {r.doc_id: (r.occurrences, r.matched_aliases) for r in entities.mention_counts(mentions).collect()}
    assert counts == {1: (2, ["Ana Sá", "Ana Sá Lima"]), 2: (2, ["Ana Sá Lima"])}
    assert mentions.agg(F.count("*")).first()[0] == 4


def _shuffled_rows(df):
    """Rows written by the exchanges of an executed plan, by depth first order."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return out


def test_anchors_bound_the_shuffle(spark):
    """With broadcasts off the places of a text that go through a shuffle are those of anchors."""
    text = " ".join(f"w{i % 50}" for i in range(400))
    docs = spark.createDataFrame([(i, text + (" w3 rare w4 " if i % 10 == 0 else "")) for i in range(200)], "doc_id int, text string").repartition(2)
    aliases = spark.createDataFrame([(1, "W3 Rare", "w3 rare", 1, 2), (1, "rare w4 w9", "rare w4 w9", 2, 3), (2, "w1 absent", "w1 absent", 1, 2)],
                                    "entity_id int, alias string, alias_key string, alias_rank int, n_tokens int")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        freq = entities.token_frequencies(docs, aliases)
        assert {r.token: r.docs for r in freq.collect()} == {"w3": 200, "w1": 200, "w4": 200, "w9": 200, "rare": 20}
        hits = entities.alias_hits(docs, aliases, frequencies=freq)
        rows = _shuffled_rows(hits)
        assert hits.count() == 20 and {(r.alias, r.start) for r in hits.collect()} == {("W3 Rare", 400)}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    print(rows)
