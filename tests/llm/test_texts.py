"""Wrong encodings, visual forms, terms, tokens, languages."""

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from titleforge.llm import langid, mojibake, terms, tokens, visual
from titleforge.llm.codepoints import from_codepoints, to_codepoints

TITLES = ["昌隆寺庙师父说了:高考论坛别慌,幼儿园来点会员漏洞", "这个灵芝孢子火了,闸渠针灸传人手术台治好乳腺增生?无需服药(CoQ10)", "社区广场,道长靠艾草灸治血脂异常?柳浦镇的人看呆了 café", "为什么记者调查山沟沟都推荐合同漏洞? Crème Brûlée", "胡萝卜真的能治眼病吗?专家这样说 Здоровье"] * 40


# Visual forms


@given(st.lists(st.one_of(st.none(), st.text(max_size=30))))
@settings(max_examples=60, deadline=None)
def test_codepoints_round_trip(texts):
    texts = [t and "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) for t in texts]
    points, offsets, nulls = to_codepoints(pa.array(texts, pa.string()))
    assert from_codepoints(points, offsets, nulls).to_pylist() == texts


@given(st.lists(st.text(st.sampled_from("aeéèq̣̇ẹ̄ё́ÅΩ한각한中\n ̧́̂"), max_size=12)))
@settings(max_examples=100, deadline=None)
def test_composition_equals_nfc(texts):
    points, offsets, nulls = to_codepoints(pa.array([unicodedata.normalize("NFD", t) for t in texts], pa.string()))
    points, offsets = visual._compose(points, offsets, visual.tables())
    assert from_codepoints(points, offsets, nulls).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


CASES = {
    "\uff21\uff22\uff01": "AB!", "\u041cRI": "MRI", "\u039212": "B12", "pur\u00e9\u0435": "pur\u00e9e", "\u0422\u0435\u0430": "Tea", "\u0421": "C", "cafe\u0301": "caf\u00e9", "a\u200bb": "ab", "a\u00a0b": "a b",
    "\u2ed4\u2f08": "\u95e8\u4eba", "\uf934": "\u8001", "\u30ed\u81ed": "\u53e3\u81ed", "\u73af\u536b\u30a8\u7aef": "\u73af\u536b\u5de5\u7aef", "x\u3000y": "x y", "\U0001d402\U0001d413": "CT",
    "\u0441\u0430f\u0435\u0301": "caf\u00e9", "\u00ada": "a", "\u200d": "", "Cr\u0450me": "Cr\u00e8me",
}
CLEAN = ["рост", "Здоровье", "カルシウム", "サプリ", "の", "건강", "α", "κ值", "、。「」《》【】—", "👨‍👩‍👧", "❤️", "5️⃣", "naïve Ångström", "a\tb\nc", "São João", ""]


def test_visual_cases():
    out, flagged = visual.unify_column(pa.array([*CASES, *CLEAN, None]))
    assert out.to_pylist() == [*CASES.values(), *CLEAN, None]
    assert flagged.tolist() == [True] * len(CASES) + [False] * (len(CLEAN) + 1)


def test_visual_frame(spark):
    df = spark.createDataFrame([(1, "ＡＢ", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (4, "中" * 70_000 + "​", "w")], "id long, title string, plain_form string")
    rows = {r.id: (r.plain_form, r.disguised) for r in visual.with_plain_form(df, "title").collect()}
    assert rows == {1: ("AB", True), 2: (None, False), 3: ("", False), 4: ("中" * 70_000, True)}
    assert visual.with_plain_form(df.limit(0), "title").count() == 0


# Wrong encodings


@pytest.fixture(scope="module")
def model():
    points, _, _ = to_codepoints(pa.array(TITLES))
    return mojibake.Model(np.bincount(points, minlength=0x110000).astype(float), TITLES)


@pytest.mark.parametrize("pair", mojibake.PAIRS, ids=lambda p: f"{p.true}>{p.wrong}*{p.times}")
@pytest.mark.parametrize("whole", [True, False])
def test_garbled_titles_are_found(model, pair, whole):
    title = TITLES[1]
    bad = pair.garble(title)[0] if whole else title[:8] + pair.garble(title[8:24])[0] + title[24:]
    points, offsets, _ = to_codepoints(pa.array([title, bad]))
    found = dict(model.label(points, offsets))
    assert 0 not in found and 1 in found
    back, met, complete = model.repair(bad, found[1])
    assert met
    if complete and pair.wrong in ("cp1252", "latin-1", "cp1251"):
        assert back == title


def test_blocks_are_bounded_by_cells(model, monkeypatch):
    texts = ["x" * 40 + mojibake.PAIRS[1].garble(TITLES[k % 5])[0] * (1 + k % 7) for k in range(30)]
    points, offsets, _ = to_codepoints(pa.array(texts))
    whole = model.label(points, offsets)
    monkeypatch.setattr(mojibake, "CELLS", 500)
    parts = model.label(points, offsets)
    assert len(whole) == 30 and all(a == b and (x == y).all() for (a, x), (b, y) in zip(sorted(whole, key=lambda r: r[0]), sorted(parts, key=lambda r: r[0])))


@pytest.mark.parametrize("title", [*TITLES[:5], TITLES[0] + " São João", TITLES[0] + "(Ærø)", TITLES[2] + "£5", TITLES[3] + "®", "ＡＢ" + TITLES[0], "​" + TITLES[1], "", "x", "中" * 20_000])
def test_clean_titles_are_not(model, title):
    points, offsets, _ = to_codepoints(pa.array([title]))
    assert not any(model.repair(title, s)[1] for _, s in model.label(points, offsets))


def test_garbled_frame(spark, model):
    bad = TITLES[1].encode().decode("latin-1")
    log = spark.createDataFrame([(1, bad), (2, TITLES[1]), (3, None), (4, ""), (1, bad)], "line_no long, title string").selectExpr("*", "1 AS whole")
    rows = mojibake.restored(log, model).collect()
    assert [(r.line_no, r.restored, r.whole) for r in rows] == [(1, TITLES[1], True)] * 2
    assert mojibake.restored(log.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "title_id long, title string")
    assert mojibake.garbled_lines(log.limit(0), empty).count() == 0
    assert mojibake.garbled_lines(log, empty).count() >= 0  # with no benchmark nothing is known, but nothing breaks


# Terms


@given(st.text(st.sampled_from("ab中😀\x00"), max_size=9))
@settings(max_examples=60, deadline=None)
def test_packed_terms(text):
    points, offsets, _ = to_codepoints(pa.array([text]))
    got, _ = terms.packed_terms(points, offsets, (2, 3))
    assert sorted(terms.unpacked(got).to_pylist()) == sorted(text[i : i + k] for k in (2, 3) for i in range(len(text) - k + 1))


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH", 10)
    data = [(i, "热词abc" if i % 3 else f"冷{i}" * 2) for i in range(60)] + [(1, "热词abc"), (99, None), (100, ""), (101, "y")]
    df = spark.createDataFrame([*data, (None, "热词abc")], "title_id long, title string").selectExpr("*", "'x' AS term").repartition(3)
    once = {i: t for i, t in data if t is not None}
    expect: dict[str, list[int]] = {}
    for t in once.values():
        all_ = [t[i : i + k] for k in (2, 3) for i in range(len(t) - k + 1)]
        for x in set(all_):
            e = expect.setdefault(x, [0, 0])
            e[0] += all_.count(x)
            e[1] += 1
    rows = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_counts(df).collect()}
    assert rows == {k: (a, b, "rare" if b < 3 else "common" if b > 0.05 * len(once) else None) for k, (a, b) in expect.items()}
    assert terms.term_counts(df.limit(0)).count() == 0
    for unit, sizes, cut in (("characters", (1, 4), lambda t: [t[i : i + k] for k in (1, 4) for i in range(len(t) - k + 1)]), ("words", (2,), lambda t: regex.findall(r"[\p{L}\p{N}]+", t)), ("values", (2,), lambda t: [t])):
        many = {(r.term, r.occurrences, r.records) for r in terms.term_counts(df, unit=unit, sizes=sizes).collect()}
        pairs = [(x, i) for i, t in once.items() for x in cut(t)]
        assert many == {(x, sum(y == x for y, _ in pairs), len({i for y, i in pairs if y == x})) for x, _ in pairs}
    with pytest.raises(ValueError):
        terms.term_counts(df, sizes=(0,))


# Tokens

LONG = "def f(x):\n    return x  +  1\n\n\n   # 标题 test's 12345 émoji 😀\t\tend" * 40 + " " * 300 + "a" * 700 + "\n" * 90 + "z  \n  y"


@pytest.fixture(scope="module")
def folder():
    if not (pytest.importorskip("pathlib").Path(tokens.vocabulary_folder()) / "byte_bpe_50k.tiktoken").exists():
        pytest.skip("no vocabulary files here")
    return tokens.vocabulary_folder()


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 20), (64, 8), (500, 100), (32_768, 1_024)])
def test_chunks_never_change_the_ids(spark, folder, chunk, overlap):
    texts = [(1, LONG), (2, None), (3, ""), (4, " "), (5, "short text"), (5, "short text"), (6, LONG[::-1]), (6, LONG[::-1]), (7, "中" * 900), (8, "<|endoftext|>" * 20)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS piece")
    encode = tokens.encoder("byte_bpe_50k", folder)
    rows = sorted((r.doc_id, r.ids) for r in tokens.token_ids(df, chunk=chunk, overlap=overlap).collect())
    assert rows == sorted((i, encode(t) if t else []) for i, t in texts)
    counts = sorted((r.doc_id, r.n_tokens) for r in tokens.token_counts(df, chunk=chunk, overlap=overlap).collect())
    assert counts == [(i, len(x)) for i, x in rows]


def test_tokens_decode_and_special_cases(spark, folder):
    df = spark.createDataFrame([(1, LONG), (2, None), (3, "")], "doc_id long, text string")
    ids = tokens.token_ids(df, null_ids=(50256,), empty_ids=(50256, 50256))
    assert {r.doc_id: r.ids for r in ids.where("doc_id > 1").collect()} == {2: [50256], 3: [50256, 50256]}
    assert tokens.decoded(ids.where("doc_id = 1")).first().text == LONG
    assert tokens.token_ids(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"])
def test_other_tokenizers(spark, folder, name):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    assert tokens.token_ids(df, tokenizer=name, chunk=100, overlap=30).first().ids == list(tokens.encoder(name, folder)(LONG))


# Languages


@pytest.fixture(scope="module")
def languages(data):
    docs, known = pd.read_parquet(f"{data}/../sf0.01/documents.parquet"), pd.read_parquet(f"{data}/lang_list.parquet")
    usual = dict(zip(known.lang, known.usual_ext))
    docs = docs[docs.lang.isin(list(usual)) & (docs.text.str.len() > 20) & (docs.lang.map(usual) == docs.file_path.str.extract(r"\.(\w+)$")[0])]
    return docs, tuple(sorted(usual))


def fitted(docs, names):
    chunks = [langid.chunks_of(t.encode(), 20) for t in docs.text]
    sizes = [len(c) for c in chunks]
    return langid.train([c for x in chunks for c in x], np.repeat([names.index(x) for x in docs.lang], sizes), np.repeat(np.arange(len(docs)), sizes), names)


def test_languages_held_out(languages):
    docs, names = languages
    half = len(docs) // 2
    model = fitted(docs[:half], names)
    test = docs[half:]
    doc, _, _, lang, sure, solid = langid._analyse(model, langid.Rules(label_weight=0.0), pa.array(test.text), [None] * len(test))
    table = np.zeros((len(test), len(names)))
    np.add.at(table, (doc, lang), solid)
    assert (np.array(names)[table.argmax(axis=1)] == test.lang.to_numpy()).mean() > 0.95
    assert ((sure > 0) & (sure <= 1)).all()
    python, sql = "import os\n\ndef f(x):\n    return [y for y in x if y]\n\n" * 8, "SELECT a, COUNT(*) FROM t WHERE b IS NOT NULL GROUP BY a;\nINSERT INTO t (a) VALUES (1);\n" * 8
    for text, expect in ((python + sql, {"python", "sql"}), (python, {"python"}), ("", set()), (" \n\t", set()), (python * 200, {"python"})):
        doc, begin, end, lang, _, solid = langid._analyse(model, langid.Rules(), pa.array([text]), ["und"])
        full = solid > 0
        assert {names[k] for k in lang[full]} == expect
        assert not expect or end[-1] == len(text.encode())


@pytest.fixture(scope="module")
def half_model(languages):
    docs, names = languages
    return fitted(docs[: len(docs) // 2], names)


PYTHON, SQL = "import os\n\ndef f(x):\n    return [y for y in x if y]\n\n", "SELECT a, COUNT(*) FROM t WHERE b IS NOT NULL GROUP BY a;\nINSERT INTO t (a) VALUES (1);\n"


def test_segments_of_long_documents(spark, half_model):
    text = PYTHON * 900 + SQL * 8 + PYTHON * 900  # a segment of about 1 % of its document
    rows = spark.createDataFrame([(1, text, "python")], "doc_id long, text string, lang string")
    got = langid.segments(rows, half_model).orderBy("segment").collect()
    assert [r.lang for r in got] == ["python", "sql", "python"]
    assert got[0].begin == 0 and got[-1].end == len(text) and abs(got[1].begin - len(PYTHON) * 900) < 100


def test_languages_in_many_short_parts(half_model):
    text = (PYTHON * 12 + SQL) * 30  # each part under 4 % of the document, the language more than a tenth
    share = len("".join(SQL.split())) / len("".join((PYTHON * 12 + SQL).split()))
    rules = langid.Rules(least_language=share / 2)
    _, _, _, lang, _, solid = langid._analyse(half_model, rules, pa.array([text]), ["python"])
    got = np.bincount(lang, weights=solid, minlength=len(half_model.names)) / solid.sum()
    assert abs(got[half_model.names.index("sql")] - share) < 0.03


def test_languages_frame(spark, data):
    docs, known = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/lang_list.parquet")
    model = langid.fit(docs, known, sample=200)
    odd = spark.createDataFrame([(1, None, None), (2, "", "und"), (3, " \n ", "sql"), (4, "x", "nosuch")], "doc_id long, text string, lang string").selectExpr("*", "1 AS confidence")
    assert {r.doc_id for r in langid.document_languages(odd, model).collect()} == {4}
    assert langid.segments(odd.limit(0), model).count() == 0
    assert langid.document_languages(docs, model).count() > 50
    assert langid.found(docs.limit(0), known).count() == 0
    none = langid.fit(docs, known.limit(0))
    assert langid.segments(docs, none).count() == 0 and langid.document_languages(docs, none).count() == 0
