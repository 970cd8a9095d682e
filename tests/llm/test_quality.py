import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from geoloom.llm import line_features as L
from geoloom.llm import line_hmm as H
from geoloom.llm.quality import fit_quality, load_model, save_model, text_quality

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def common():
    return L.common_hashes(pq.read_table(f"{FOLDER}/common_words.parquet").column("word").to_pylist())


TABLE = "".join(f"Town{i};{i * 37 % 100};{i * 7919 % 10_000};{i * 3}.{i % 10}\n" for i in range(40))


def labelled():
    documents = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: r["text"] for r in documents}
    labels = pq.read_table(f"{FOLDER}/doc_labels.parquet").to_pylist()
    rows = [(texts[r["doc_id"]], H.LABELS.index(r["label"])) for r in labels]
    return [r for r in rows if r[0] and r[0].strip()]


def test_held_out_labels(common):
    rows = labelled()
    train, test = [r for i, r in enumerate(rows) if i % 2], [r for i, r in enumerate(rows) if i % 2 == 0]
    model = H.fit([t for t, _ in train], np.array([n for _, n in train]), common)
    lines = L.Lines(pa.array([t for t, _ in test]), common)
    path = model.label(lines.features, lines.text)
    prose = np.bincount(lines.text, lines.chars * (path == 0), len(test)) * 2 >= np.bincount(lines.text, lines.chars, len(test))
    truth = np.array([n for _, n in test]) == 0
    assert (prose == truth).mean() >= 0.97
    assert (~prose & ~truth).sum() >= 0.9 * (~truth).sum()


def test_line_statistics(common):
    text = "The cat sat.\r\n\n  - item one\nA\tB\tC 12"
    lines = L.Lines(pa.array([None, "", text, " \n  ", text]), common)
    assert lines.text.tolist() == [2, 2, 2, 4, 4, 4] and lines.text_chars.tolist() == [0, 0, len(text), 4, len(text)]
    assert lines.chars.tolist() == [12, 12, 8] * 2 and lines.words.tolist() == [3, 2, 4] * 2
    by = {n: lines.features[:3, i] for i, n in enumerate(L.NAMES)}
    assert by["ends_stop"].tolist() == [1, 0, 0] and by["bullet"].tolist() == [0, 1, 0]
    assert by["columns"][2] > 0 and by["digits"][2] == pytest.approx(2 / 8)
    assert (lines.features[:3] == lines.features[3:]).all()  # texts do not see each other


@pytest.mark.parametrize("texts", [[], [None], [""], [" \n\t "], [" ", None, "\n"], ["--- ***"], [" ", "x"]])
def test_batches_with_little_in_them(common, texts):
    lines = L.Lines(pa.array(texts, pa.string()), common)
    solid = [i for i, t in enumerate(texts) if t and t.strip()]
    assert lines.text.tolist() == solid and len(lines.features) == len(solid)


def test_common_words_ignore_case(common):
    lines = L.Lines(pa.array(["THE xyzzy the Of"]), common)
    assert lines.common.tolist() == [3]
    assert L.Lines(pa.array(["the of"]), L.common_hashes([])).common.tolist() == [0]


def test_long_lines_come_in_pieces(common):
    lines = L.Lines(pa.array(["word " * 100, "x" * 100_000]), common)
    assert np.bincount(lines.text).tolist() == [3, 500] and lines.chars.sum() == 500 + 100_000
    assert (~lines.inner_piece).sum() == 2


def brute_path(emit, start, step):
    import itertools

    best = max(
        itertools.product(range(emit.shape[1]), repeat=len(emit)),
        key=lambda p: start[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:])),
    )
    return list(best)


def test_best_paths():
    rng = np.random.default_rng(0)
    lengths = [1, 5, 3, 5, 2]
    text = np.repeat(np.arange(len(lengths)), lengths)
    emit, start, step = rng.normal(size=(len(text), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got = H.best_paths(emit, text, start, step)
    want = [s for t in range(len(lengths)) for s in brute_path(emit[text == t], start, step)]
    assert got.tolist() == want
    assert len(H.best_paths(np.empty((0, 3)), np.empty(0, int), start, step)) == 0


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "The house is open.\nIt was late, and all of them went home.", "x"),
            (5, TABLE, "x"), (5, TABLE, "x"), (None, "The end.", "x"), (6, "a" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    words = spark.read.parquet(f"{FOLDER}/common_words.parquet")
    model = fit_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/doc_labels.parquet"), words, most_labelled=300)
    got = {r.doc_id: r for r in text_quality(df, "doc_id", "text", model).collect()}
    assert all(got[i].label is None and got[i].prose_share is None and got[i].n_words == 0 for i in (1, 2, 3))
    four = got[4]
    assert (four.label, four.n_lines, four.n_words, four.stop_line_share, four.n_chars) == ("prose", 2, 13, 1.0, 58)
    assert four.prose_share + four.list_share + four.table_share + four.junk_share == pytest.approx(1)
    assert got[5].label == "table" and got[5].n_lines == 40 and got[None].n_words == 2 and got[6].n_chars == 200_000
    assert text_quality(df.limit(0), "doc_id", "text", model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, label string")
    nothing = fit_quality(df, labels, words.limit(0))
    assert {r.label for r in text_quality(df, "doc_id", "text", nothing).collect()} == {None, "prose"}


def test_saved_models(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate([TABLE, "A plain sentence, and another one. " * 5, "- item\n- item two\n- three"] * 4)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, ("table", "prose", "list")[i % 3]) for i, _ in texts], "doc_id long, label string")
    words = spark.createDataFrame([("and", 1)], "word string, word_rank int")
    model = fit_quality(documents, labels, words)
    for m in (model, fit_quality(documents, labels.limit(0), words)):
        save_model(spark, m, str(tmp_path / "model"))
        again = load_model(spark, str(tmp_path / "model"))
        rows = [sorted(text_quality(documents, "doc_id", "text", x).collect()) for x in (m, again)]
        assert rows[0] == rows[1]
    small = fit_quality(documents, labels, words, most_bytes=8 * len(TABLE) - 1)
    assert small.lines is not None  # without the tables
    assert fit_quality(documents, labels, words, most_bytes=8).lines is None


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (1000, 10), (5000, 2**62), (200_000, 50_000)])
def test_repeated_keys(n, top):
    keys = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    want = np.ones(n, bool)
    want[np.unique(keys, return_index=True)[1]] = False
    assert (L.repeated(keys) == want).all()
    assert (L.repeated(keys << np.uint64(40)) == L.repeated(keys % np.uint64(1 << 24))).all()
