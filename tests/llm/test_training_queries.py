"""The registered queries for training data on small tables: against SQL, or against what their tables hold."""

import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from test_queries import TYPES, rows

from titleforge.llm import queries, tokens, visual
from titleforge.llm.codepoints import to_codepoints


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    df = queries.QUERIES[name](spark, data)
    assert rows(df.toPandas()) == rows(con.execute(queries.SQL[name]).fetchdf())
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + queries.SQL[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds


def read(data, name):
    return pd.read_parquet(f"{data}/{name}.parquet")


def got(spark, data, name):
    out = queries.QUERIES[name](spark, data).toPandas()
    assert len(out.columns) == len(set(out.columns)) and len(out)
    return out


def near(a, b, most=3):
    if abs(len(a) - len(b)) > most:
        return False
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, np.empty_like(row)
        row[0] = i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1] <= most


def key(text):
    return regex.sub(r"[^\p{L}\p{N}]", "", text.lower())


def test_p1(spark, data):
    log, found = read(data, "prediction_log"), got(spark, data, "p1_found")
    assert set(found.line_no) <= set(log.line_no) and found.line_no.is_unique
    back = got(spark, data, "p1_originals")
    assert set(back.line_no) == set(found.line_no)
    known = set(read(data, "titles").title) | set(read(data, "anchor_titles").title)
    assert back.original.isin(known).mean() > 0.5  # many of the logged titles are the benchmark's
    clean = log[log.title.isin(known)]
    assert not set(clean.line_no) & set(found.line_no)


def test_p2(spark, data):
    import pyarrow as pa

    titles = read(data, "titles").dropna(subset=["title"]).drop_duplicates("title_id")
    points, offsets, _ = visual.unify(*to_codepoints(pa.array(titles.title.tolist()))[:2])
    text = "".join(map(chr, points.tolist()))
    titles["key"] = [key(text[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    train, other = titles[titles.split == "train"], titles[titles.split != "train"]
    expect = {tuple(sorted((int(a.title_id), int(b.title_id)))) for a in train.itertuples() for b in other.itertuples() if near(a.key, b.key)}
    found = got(spark, data, "p2_found")
    assert Counter(map(tuple, found[["a_id", "b_id"]].to_numpy().tolist())) == Counter(expect)
    report = got(spark, data, "p2_report")
    assert report.titles.sum() == len(other) and report.exact.sum() + report.near.sum() == len({t for pair in expect for t in pair} & set(other.title_id))


def test_p5(spark, data):
    titles, plain = read(data, "titles"), got(spark, data, "p5_plain")
    assert set(plain.title_id) == set(titles.title_id)
    assert set(got(spark, data, "p5_found").title_id) == set(plain.title_id[plain.disguised])
    changed = plain.merge(titles.drop_duplicates(["title_id", "title"]), on="title_id")
    assert (changed.plain_form[~changed.disguised & changed.title.notna()] == changed.title[~changed.disguised & changed.title.notna()]).all()


def test_p6(spark, data):
    titles = read(data, "ml_titles").dropna(subset=["title"]).drop_duplicates(["row_id", "title"])
    known = [(int(r.row_id), key(r.title), sorted(regex.findall(r"[\p{L}\p{N}]+", r.title.lower()))) for r in titles.itertuples()]
    root = {i: i for i, _, _ in known}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x, p) in enumerate(known):
        for b, y, q in known[:n]:
            if p == q or near(x, y):
                a_top, b_top = top(a), top(b)
                root[max(a_top, b_top)] = min(a_top, b_top)
    found = got(spark, data, "p6_found")
    assert Counter(map(tuple, found[["first_id", "other_id"]].to_numpy().tolist())) == Counter((top(i), i) for i in root if top(i) != i)


def test_p8_and_p9(spark, data):
    if not os.path.exists(f"{tokens.vocabulary_folder()}/byte_bpe_50k.tiktoken"):
        pytest.skip("no vocabulary files here")
    docs, encode = read(data, "documents"), tokens.encoder("byte_bpe_50k", tokens.vocabulary_folder())
    expect = Counter((d, tuple(encode(t)) if t else ()) for d, t in zip(docs.doc_id.tolist(), docs.text.tolist()))
    for name in ("p8_ids", "p8_chunks"):
        ids = got(spark, data, name)
        assert Counter(zip(ids.doc_id.tolist(), map(tuple, ids.ids))) == expect
    packing = got(spark, data, "p9_packed")
    sizes = sum(len(k[1]) * n for k, n in expect.items())
    for _, one in packing.groupby("bin_set"):
        assert one.n_tokens.sum() == sizes and (one.groupby("container").n_tokens.sum() <= one.capacity.iloc[0]).all()
    assert (got(spark, data, "p9_report").used_share > 0.9).all()


def test_p10(spark, data):
    docs, names = read(data, "documents"), set(read(data, "lang_list").lang)
    found = got(spark, data, "p10_found")
    assert set(found.lang) <= names and not found.duplicated().any()
    blank = docs[docs.text.isna() | (docs.text.str.strip() == "")]
    assert not set(found.doc_id) & set(blank.doc_id)
    per = found.groupby("doc_id").size()
    alone = found[found.doc_id.isin(per.index[per == 1])].merge(docs.drop_duplicates("doc_id"), on="doc_id", suffixes=("", "_label"))
    assert (alone.lang != alone.lang_label).all()
    unlabelled = docs[(docs.lang.isna() | docs.lang.isin(["", "und"])) & ~docs.doc_id.isin(blank.doc_id)]
    assert set(unlabelled.doc_id) <= set(found.doc_id)
    parts = got(spark, data, "p10_segments")
    assert ((parts.confidence > 0) & (parts.confidence <= 1)).all() and (parts.end > parts.begin).all()
