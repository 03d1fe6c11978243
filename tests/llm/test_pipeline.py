"""The pipeline against the same decisions taken in plain Python."""


import corpus_pipeline
from fathom.llm import language_id
from tests.llm.conftest import SF
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import brute_pieces, check_bins
from tests.llm.test_simhash import brute_fingerprint, brute_roots


def brute(rows, model, tests):
    """rows: (doc_id, text, lang, source, n_chars) -> the packed pieces."""
    kept = [r for r, p in zip(rows, model.predict([r[1] for r in rows])) if not p[2]]
    kept = [(r[0], x[1], *r[2:]) for r, x in zip(kept, brute_lines(kept, 0.05, 5))]
    fp = [brute_fingerprint(r[1]) for r in kept]
    roots, first = brute_roots(fp), {}
    for r, f in zip(kept, fp):
        first[roots[f]] = min(first.get(roots[f], r[0]), r[0])
    kept = [r for r, f in zip(kept, fp) if first[roots[f]] == r[0]]
    leaks = brute_leaks([(r[0], r[1]) for r in kept], tests)
    return brute_pieces([(r[0], r[1]) for r, x in zip(kept, leaks) if not x[5]], 2048)


def test_like_brute_force(spark, table):
    docs = table("documents")
    want = brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()], language_id.fit(docs),
                 [tuple(r) for r in table("benchmark").select("item_id", "text").collect()])
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == sorted(want)
    check_bins(got, 2048)


def test_stages_take_odd_and_empty_documents(spark, odd, none):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).collect() == []
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        n = out.count()
        assert n == docs.count() if name == "line_dedup" else 0 < n < docs.count() or name == "decontamination"
        docs = out


def test_stages_are_the_operators():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
