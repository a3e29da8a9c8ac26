import random
import re

import public_tokenizers
import pytest
from helpers import plain_components
from test_decontamination import plain as plain_hits
from test_pii import plain as plain_spans
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from emberfall.llm import pii, queries, simhash

COLUMNS = corpus_pipeline.COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    good = [text(rng.randrange(20, 120)) for _ in range(90)]
    junk = [" ".join(w.upper() + "!!" for w in text(30).split()) for _ in range(40)]
    rows = list(enumerate(good)) + [(200 + i, t) for i, t in enumerate(junk)]
    for i in range(15):
        words = (good[i] + " " + text(60)).split()
        rows += [(300 + 2 * i, " ".join(words)), (301 + 2 * i, " ".join([*words[:40], "changed", *words[41:]]))]
    rows += [(400 + i, good[i]) for i in range(5)] + [(500, None), (501, ""), (None, text(30)), (7, good[7])]
    rows += [(600, text(20) + " mail me at someone@example.org or +49 30 1234567 now " + text(5))]
    items = [(i, text(14)) for i in range(5)]
    rows += [(700 + i, text(20) + " " + t.upper() + ". " + text(9)) for i, t in items]
    labels = [(i, 1, 0) for i in range(90)] + [(200 + i, 0, 0) for i in range(40)]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], items, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows, items, labels = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{folder}/stage{i}")
        kept.append(spark.read.parquet(f"{folder}/stage{i}"))
    return folder, items, kept


def pairs(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def test_columns_and_run(spark, stages):
    folder, _, kept = stages
    assert all(k.columns == COLUMNS for k in kept[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier",
        "simhash near-dedup",
        "benchmark decontamination",
        "pii",
        "bpe encoding and decoding",
    ]
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(again, key=str) == sorted(kept[-1].collect(), key=str)


def test_quality_stage_rejects_junk_and_keeps_the_rest(stages):
    _, _, kept = stages
    left = {r.doc_id for r in kept[1].collect()}
    assert not left & set(range(200, 240)) and set(range(90)) <= left


def test_one_of_each_group_stays(stages):
    """Of documents whose fingerprints differ in at most 3 of 64 bits one stays."""
    _, _, kept = stages
    rows = pairs(kept[1])
    codes = [int(simhash.fingerprint(simhash.shingle_hashes(t, 3), 1)[0]) for _, t in rows]
    roots = plain_components(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = {}
    for (i, t), root in zip(rows, roots):
        groups.setdefault(root, []).append((i is None, i or 0, i, t))
    want = [min(g, key=lambda x: x[:2])[2:] for g in groups.values()]
    got = pairs(kept[2])
    assert got == sorted(want, key=str)
    ids = {i for i, _ in got}
    assert not ids & {400, 401, 402, 403, 404} and len(ids & set(range(300, 330))) < 30


def test_contaminated_documents_go(stages):
    _, items, kept = stages
    rows = pairs(kept[2])
    clean = [(i, t) for i, t in rows if plain_hits([(i, t)], items)[0][2] == 0]
    assert pairs(kept[3]) == clean and len(rows) - len(clean) == 5


def test_personal_data_is_hidden(stages):
    _, _, kept = stages
    before, after = {i: t for i, t in pairs(kept[3])}, {r.doc_id: r for r in kept[4].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        want, shift = text, 0
        for kind, a, b in (s.split(":") for s in plain_spans(text)):
            want = want[: int(a) + shift] + f"<{kind}>" + want[int(b) + shift :]
            shift += len(kind) + 2 - (int(b) - int(a))
        assert after[i].text == want
        assert after[i].n_chars == (None if want is None else len(want))
    assert "<email>" in after[600].text and "<phone>" in after[600].text


def test_tokens_of_what_is_left(stages):
    _, _, kept = stages
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {i: t for i, t in pairs(kept[4])}
    for r in kept[5].collect():
        assert r.ids == ",".join(map(str, library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids))


def test_every_operator_has_a_query():
    names = entry_module.queries()
    for n in range(1, 14):
        assert len([x for x in names if re.match(rf"op{n}_", x)]) == 1
    assert "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert len(pii.BASE) == 4
