"""The pipeline on small tables, stage by stage, and the entry without the subpackage."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as driver

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == names
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "mixing", "tokens"]
    ids = {n: {r["doc_id"] for r in df.collect()} for n, df in seen.items()}
    assert ids["near_duplicates"] < ids["toxicity"] and ids["repeated_strings"] == ids["near_duplicates"]
    assert ids["mixing"] == ids["tokens"] <= ids["repeated_strings"]
    assert all(r["n_tokens"] == len(r["ids"]) for r in seen["tokens"].collect())
    assert driver.queries()["pipeline"](spark, SF).count() == seen["tokens"].count()


def test_stages_take_rows_that_lack_something(spark):
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (None, "no id", "en", "a", 5), (3, "same text here now", None, "a", 18), (4, "same text here now", "en", None, 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.where("false")):
        out = given
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        out.collect()
    kept = corpus_pipeline.distinct(spark, docs, SF)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3]


def test_near_duplicates_by_five_words(spark):
    """The kept documents are those of a brute force over all pairs of sets of five-word shingles."""
    words, texts = [f"w{i}" for i in range(72)], {}
    for number, edits in enumerate([[], [20], [20, 50], [10, 35, 60], [3, 4]]):
        for base in (0, 1):  # two edits: four-word similarity 61/77, with 90 words 79/95
            own = [f"{'xy'[base]}{w}" for w in words + [f"v{i}" for i in range(18)] * base]
            texts[10 * number + base] = " ".join("edit" + str(number) + w if i in edits else w for i, w in enumerate(own))

    def kept(size):
        sets = {i: {tuple(t.split()[k : k + size]) for k in range(len(t.split()) - size + 1)} for i, t in texts.items()}
        root = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        root[a] = root[b] = min(root[a], root[b])
        return sorted(i for i in sets if root[i] == i)

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, SF).collect()) == kept(5) != kept(4)


def test_one_row_of_each_group_keeps_its_text(spark):
    """Repeated ids and copies without id: one row stays, and the repeated-strings stage leaves its text."""
    text = {k: " ".join(f"{k}{i}" for i in range(100)) for k in "abcd"}
    rows = [(7, text["a"]), (7, text["a"]), (None, text["b"]), (None, text["b"]), (9, text["c"]), (None, text["c"]), (4, text["c"]), (7, text["d"]), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.distinct(spark, docs, SF)
    expected = sorted([(7, text["a"]), (None, text["b"]), (4, text["c"]), (7, text["d"]), (None, None), (None, None)], key=repr)
    for df in (out, corpus_pipeline.without_repeats(spark, out, SF)):
        assert sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr) == expected


def test_stages_take_columns_with_clashing_names(spark):
    """Names that the operators use inside are carried through every stage."""
    names = ["row_key", "row", "id", "n", "codes", "component_id", "first", "size", "taken", "score", "doc", "component"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == i for r in rows for i, n in enumerate(names))
    assert corpus_pipeline.tokens(spark, out, SF).count() == len(rows)


def test_every_operator_is_registered():
    names = [n.split("_")[0] for n in driver.queries()]
    assert {f"op{i}" for i in range(1, 14)} <= set(names)


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and registers its queries when the operators are taken out."""
    shutil.copytree(os.path.join(ROOT, "riskweave"), tmp_path / "riskweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'd18_decisions' in n and 'pipeline' not in n and set(e.oracle_sql()) == set(n)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
