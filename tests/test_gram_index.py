import random

from conftest import rows
from trackspan.operators import lookup
from trackspan.operators.gram_index import SubstringIndex

TEXTS = "id long, text string, tag string"


def by_hand(texts, needles):
    out = []
    for i, text, tag in texts:
        for n in needles:
            out += [(n, tag, s + 1) for s in range(len(text or "")) if n and text.startswith(n, s)]
    return sorted(out, key=repr)


def sample(seed, n=60):
    rnd = random.Random(seed)
    texts = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 14))), f"t{i}") for i in range(n)]
    needles = ["", "a", "é", "ab", "abc", "zzz", "aaaaaaaaaaaaaaaaaa", *("".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 6))) for _ in range(40))]
    return texts, sorted(set(needles))


def found(index, spark, needles):
    return rows(index.occurrences(spark.createDataFrame([(n,) for n in needles], "needle string"), "needle"), "needle", "tag", "start")


def test_every_occurrence_is_found(spark, tmp_path):
    texts, needles = sample(1)
    index = SubstringIndex(spark, str(tmp_path), "tag string", buckets=4)
    index.update(0, spark.createDataFrame(texts + [(99, None, "none")], TEXTS))
    assert found(index, spark, needles) == by_hand(texts, needles)
    plain = lookup.occurrences(spark.createDataFrame(texts, TEXTS), "text", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle")
    assert rows(plain, "needle", "tag", "start") == by_hand(texts, needles)


def test_texts_change_and_go(spark, tmp_path):
    texts, needles = sample(2)
    index, held = SubstringIndex(spark, str(tmp_path), "tag string", buckets=4, every=2), {}
    rnd = random.Random(3)
    for batch in range(5):
        some = [(i, "".join(rnd.choice("abcé ") for _ in range(9)), f"t{i}") for i in rnd.sample(range(40), 12)]
        gone = [(i,) for i in rnd.sample(range(40), 5) if i not in {s[0] for s in some}]
        for _ in range(1 + batch % 2):  # every other batch comes twice
            index.update(batch, spark.createDataFrame(some, TEXTS), spark.createDataFrame(gone, "id long"))
        held |= {s[0]: s for s in some}
        held = {i: s for i, s in held.items() if (i,) not in gone}
    assert found(index, spark, needles) == by_hand(held.values(), needles)


def test_lookups_read_the_buckets_of_their_grams(spark, tmp_path):
    texts, _ = sample(4)
    index = SubstringIndex(spark, str(tmp_path), "tag string", buckets=16)
    index.update(0, spark.createDataFrame(texts, TEXTS))
    plan = index.occurrences(spark.createDataFrame([("abc",)], "needle string"), "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("#", " ").replace("isnotnull(", "[") or "PartitionFilters: [isnotnull(bucket" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_an_empty_index(spark, tmp_path):
    index = SubstringIndex(spark, str(tmp_path), "tag string")
    assert found(index, spark, ["a", "abc"]) == []
    index.update(0, spark.createDataFrame([], TEXTS))
    assert found(index, spark, ["a", "abc"]) == []


def test_postings_do_not_meet_needles_one_by_one(spark, tmp_path, monkeypatch):
    """Needles as long that have a gram at the same place are looked up together: lookups do not grow with the needles."""
    from trackspan.operators import gram_index as G
    texts = [(i, f"name c{i:05}", "t") for i in range(300)]
    index = SubstringIndex(spark, str(tmp_path), "tag string", buckets=4)
    index.update(0, spark.createDataFrame(texts, TEXTS))
    shapes, stage = [], G.stage
    monkeypatch.setattr(G, "stage", lambda df, name: shapes.append((name, df.count())) or stage(df, name))
    for n in (40, 400):
        needles = [f"name c{i * 7 % 1000:05}" for i in range(n)]
        assert found(index, spark, needles) == by_hand(texts, sorted(set(needles)))
    counts = [n for name, n in shapes if name in ("shapes", "rarest")]
    assert len(counts) == 2 and counts[0] <= 40 and counts[1] <= 10


def test_positions_are_dropped_by_what_few_characters_begin(spark, monkeypatch):
    """Thousands of heads begin with few triples of characters, and these part positions before heads, which may be too many to broadcast."""
    kept, stage = {}, lookup.stage
    monkeypatch.setattr(lookup, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    needles = [f"c{i}" for i in range(0, 3000, 3)] + ["ab", "é", ""]
    texts = [(i, f"name c{i} ab", "t") for i in range(40)] + [(90, None, "none"), (91, "", "empty"), (92, "é", "one")]
    plain = lookup.occurrences(spark.createDataFrame(texts, TEXTS), "text", spark.createDataFrame([(n,) for n in needles], "needle string"), "needle")
    assert rows(plain, "needle", "tag", "start") == by_hand(texts, needles)
    assert kept["heads"].count() == 1002 and kept["begins"].count() <= 110
