import pathlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from brute import words
from test_dedup import components, marked, shingles
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from labelvec.llm import mixing
from labelvec.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF_DIR).exists(), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, the first being ``documents``."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, out = docs.columns, [docs.collect()]
    for i, (_, step) in enumerate(pipeline.STAGES):
        docs = step(spark, docs, SF_DIR)
        assert docs.columns == columns or i == len(pipeline.STAGES) - 1
        docs = docs.persist()
        out.append(docs.collect())
    return out


def test_rejected_documents_go(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    assert set(stages[1]) <= set(stages[0])
    right = [(i in kept) == bool(labels[i]) for i in (r.doc_id for r in stages[0]) if i in labels]
    assert sum(right) / len(right) > 0.97


def test_one_of_each_group_stays(stages):
    found = components({r.doc_id: shingles(r.text, 5) for r in stages[1]}, 80)
    assert sorted(stages[2]) == sorted(r for r in stages[1] if found[r.doc_id] == r.doc_id)


def test_repeats_are_cut(stages):
    texts = sorted((r.doc_id, r.text) for r in stages[2])
    cut = marked(texts)
    want = {i: [w for k, w in enumerate(words(t)) if k not in cut[i]] for i, t in texts}
    assert {r.doc_id: words(r.text) for r in stages[3]} == {i: ws for i, ws in want.items() if ws}
    assert all(r.n_chars == len(r.text) for r in stages[3])
    untouched = {i: t for i, t in texts if not cut[i]}
    assert all(r.text == untouched[r.doc_id] for r in stages[3] if r.doc_id in untouched)


def test_sources_come_near_their_targets(spark, stages):
    sizes, taken = Counter(), Counter()
    texts = {r.doc_id: r for r in stages[3]}
    for r in stages[3]:
        sizes[r.source] += len(words(r.text))
    for r in stages[4]:
        assert r.text in texts[r.doc_id].text and r.source == texts[r.doc_id].source
        taken[r.source] += len(words(r.text))
    targets = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2.0)
    for r in targets.collect():
        assert abs(taken[r.source] - r.target) <= 16
    whole = Counter(r.doc_id for r in stages[4])
    assert max(whole.values()) <= 4


def test_every_text_is_encoded(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for r in stages[4]:
        want[r.doc_id].append(library.encode(r.text, add_special_tokens=False).ids)
    got = defaultdict(list)
    for r in stages[5]:
        got[r.doc_id].append(r.ids)
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}


def test_the_registered_query_runs_all_stages(spark, stages):
    rows = entry.queries()["pipeline"](spark, SF_DIR).select("doc_id", "ids").collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted((r.doc_id, r.ids) for r in stages[5])


def test_the_library_works_without_these_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(entry.__file__).parent
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(entry.queries()) - len(QUERIES) - 1), "False"]  # and the pipeline


@pytest.mark.parametrize("table", ["odd", "nothing"])
def test_odd_rows_and_an_empty_table_pass_all_stages(spark, odd, nothing, tmp_path, table):
    docs = {"odd": odd, "nothing": nothing}[table].selectExpr("*", "1 AS spans", "'o' AS _of", "doc_id AS score", "2 AS src")
    path = str(tmp_path / table)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(10, 1, 0), (12, 1, 0), (19, 1, 0), (20, 0, 0), (24, 0, 0), (13, 0, 1), (None, 1, None), (11, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    frame = spark.read.parquet(f"{path}/documents.parquet")
    for i, (_, step) in enumerate(pipeline.STAGES):
        before = Counter(r.doc_id for r in frame.select("doc_id").collect())
        frame = step(spark, frame, path).persist()
        after = Counter(r.doc_id for r in frame.select("doc_id").collect())
        assert set(after) <= set(before)
        if i < len(pipeline.STAGES) - 1:
            assert frame.columns == docs.columns
    assert table == "odd" or frame.count() == 0
    rows = pipeline.run(spark, path).collect()
    assert sorted(map(str, rows)) == sorted(map(str, frame.collect()))
