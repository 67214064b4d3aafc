"""Operators do their whole job where an earlier version left part of it out."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import ann, licenses, linededup, minhash, packing, pii, substring
from cloakwork.llm.graph import link
from cloakwork.llm.scratch import shared_dir, stash


def _lines(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r.doc_id: r.n_removed for r in linededup.summary(docs).collect()}


def test_lines_with_an_edit_are_removed(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def changed(line, edits):
        at = rng.sample([i for i, c in enumerate(line) if c != " "], edits)
        return "".join(rng.choice([x for x in letters if x != c]) if i in at else c for i, c in enumerate(line))

    one, many = [], []
    for n in (3, 8, 10, 12, 20, 30):
        for _ in range(20):
            line = " ".join("".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(n))
            one.append((line, changed(line, 1)))
            many.append((line, changed(line, max(1, len(line) // 10))))
    for pairs, least in ((one, 0.97), (many, 0.9)):
        got = _lines(spark, [x for pair in pairs for x in pair])
        assert all(got[2 * i] == 0 for i in range(len(pairs)))
        assert sum(got[2 * i + 1] for i in range(len(pairs))) >= least * len(pairs)


def test_sketches_of_lines_go_before_lines_meet(spark, monkeypatch):
    held, during = {}, []
    written, gone, link_lines = linededup.stash, linededup.discard, linededup.link

    def stash_named(df, name):
        out = written(df, name)
        held[out._stash] = name
        return out

    def discard_named(*tables):
        for t in tables:
            held.pop(getattr(t, "_stash", None), None)
        gone(*tables)

    def link_seen(*given):
        during.extend(held.values())
        return link_lines(*given)

    for name, f in (("stash", stash_named), ("discard", discard_named), ("link", link_seen)):
        monkeypatch.setattr(linededup, name, f)
    assert _lines(spark, ["one two three four", "one two three five\none two three four"]) in ({0: 0, 1: 2}, {0: 0, 1: 1})
    assert "line-places" in during and not {"lines", "line-keys"} & set(during)


def test_every_alike_pair_of_a_bucket_is_linked(spark):
    # In bucket k, nodes 1000 k + 1 to 1000 k + 60 are unlike but for two pairs; bucket 9 also has 500 alike ones.
    rows = [(k, 1000 * k + i) for k in range(10) for i in range(1, 61)] + [(9, 100_000 + i) for i in range(500)]
    alike = {(1000 * k + 3 + k, 1000 * k + 40 + k) for k in range(10)} | {(1000 * k + 20, 1000 * k + 21) for k in range(10)}
    wanted = spark.createDataFrame(sorted(alike), "a bigint, b bigint")
    buckets = stash(spark.createDataFrame(rows, "key bigint, node bigint"), "test-buckets")

    def verify(pairs):
        return pairs.join(wanted, ["a", "b"], "left_semi").unionByName(pairs.filter((F.col("a") >= 100_000) & (F.col("b") >= 100_000)))

    got = {r.node: r.root for r in link(buckets, verify, "test").collect()}
    assert all(got.get(b) == a for a, b in alike)
    assert {got.get(100_000 + i) for i in range(500)} == {100_000}
    assert len(got) == 2 * len(alike) + 500


def test_long_secrets_are_masked_to_their_end(spark):
    long = "Ab3" * 400
    texts = [f'token = "{long}" end', f"password: '{long}' end", f"api_key={long} end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.text for r in pii.mask(docs).collect()} == {"[SECRET] end"}


def test_passages_around_a_quote_of_others_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    some = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(25):
        passage = some(60)
        texts += [some(20) + passage + some(20), some(30) + passage + some(10)]
        texts += [some(20) + passage[10:50] + some(20) for _ in range(8)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id for r in substring.repeats(docs).collect()}
    assert got == {i for i in range(len(texts)) if i % 10 < 2}


def test_groups_and_places_of_passages_are_linked(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    some = lambda n: [word() for _ in range(n)]
    texts = []
    for _ in range(20):
        # Four texts share p, two and two of them what follows it; two more share q and, elsewhere, an edited s. Others quote them too briefly.
        p, one, two, q, s = some(60), some(60), some(60), some(60), some(54)
        edited = s[:26] + some(1) + s[27:]
        texts += [some(20) + p + one + some(9), some(30) + p + one + some(8), some(25) + p + two + some(9), some(15) + p + two + some(7)]
        texts += [some(20) + q + some(30) + s + some(9), some(30) + q + some(20) + edited + some(9)]
        texts += [some(20) + p[8:52] + some(30) + s[5:49] + some(20) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = substring.repeats(docs).collect()
    pairs = {(r.doc_id, r.ref_doc_id) for r in rows} | {(r.ref_doc_id, r.doc_id) for r in rows}
    firsts = range(0, len(texts), 18)
    assert all(any((first + a, first + b) in pairs for a in (0, 1) for b in (2, 3)) for first in firsts)
    # Two functions of four agree on passages as alike as these with probability 0.97.
    both = [all(len({r.start_word for r in rows if r.doc_id == first + d}) == 2 for d in (4, 5)) for first in firsts]
    assert sum(both) >= 18, both


def test_a_passage_twice_in_the_smaller_text_has_two_rows(spark):
    rng = random.Random(9)
    some = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]
    texts = []
    for _ in range(20):
        p = some(60)
        texts += [some(20) + p + some(20) + p + some(9), some(30) + p + some(8)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = substring.repeats(docs).collect()
    for first in range(0, len(texts), 2):
        assert {r.start_word for r in rows if r.doc_id == first} == {20, 100}


def test_an_agreeing_function_far_off_in_the_seeds_counts():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    a, b = (np.concatenate((rng.integers(0, 1 << 63, 200).astype(np.uint64), shared)) for _ in range(2))
    far = [(0, 100 + i, 215 + i % 2, 260, 0, 130 - i, 260) for i in range(80)]
    seeds = [(0, 200, 210, 260, 200, 210, 260), *far, (1, 200, 230, 260, 200, 230, 260)]
    assert [p[:4] for p in substring.passages(a, b, seeds)] == [(200, 264, 200, 264)]


def test_wrapped_notices_are_confirmed(spark):
    mit = "Some words before it\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the Software), to deal in the Software\n\nother words"
    bsd = "/*\n * Redistribution and use in source and binary forms,\n * with or without modification, are permitted provided\n * that the following conditions are met:\n */"
    rows = [(1, mit), (2, bsd), (3, "Permission is hereby\ngranted to fish here"), (4, "Released under the MIT License\nLicensed under the Apache License, Version 2.0")]
    got = {r.doc_id: (r.licence, r.confirmed) for r in licenses.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == ("MIT", 1) and got[2] == ("BSD-3-Clause", 1) and got[3] == (None, 0) and got[4][1] == 2


def test_licences_are_told_by_row(spark):
    rows = [(1, "Released under the MIT License"), (1, "Released under the MIT License"), (None, "Licensed under CC BY-NC 4.0"), (None, "words of no licence at all"), (1, "other words of no licence")]
    got = sorted((str(r.doc_id), str(r.licence), r.notices) for r in licenses.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [("1", "MIT", 1), ("1", "MIT", 1), ("1", "None", 0), ("None", "CC-BY-NC-4.0", 1), ("None", "None", 0)]


def test_planted_licence_lines_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id for r in licenses.report(docs).collect() if r.licence}
    planted = {d for d, t in rows.items() if any(x.startswith(("Licensed under", "Released under", "This work is licensed", "SPDX-License")) for x in t.split("\n"))}
    assert len(planted) > 20 and len(got & planted) >= 0.95 * len(planted) and len(got & planted) >= 0.95 * len(got)


def test_repeated_documents_count_their_lines_once(spark):
    rows = [(1, "one two three four\nfive six seven eight"), (1, "one two three four\nfive six seven eight"), (2, "one two three four\nnine ten eleven twelve")]
    got = sorted((r.doc_id, r.n_lines, r.removed) for r in linededup.summary(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 2, []), (1, 2, []), (2, 2, [0])]


def test_unlike_texts_with_one_id_both_stay(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, words), (1, words), (None, "some other words that nobody has written before this"), (None, "quite different from all of the others here, is it not"), (1, "and one more text that has the same number as the first")]
    kept = minhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_each_row_of_a_repeated_vector_asks(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.1])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(20, 1, 20), (20, 1, 20), (20, 2, 1), (20, 2, 1)]


def test_the_index_finds_the_nearest(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(np.float64)
    assert len(ids) > 4 * ann.LEAST and int(ann.SHARE * min(len(ids), ann.SHARD)) > 20
    found = {}
    for r in ann.search(table).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((ids, -scores))[:20]
        own = sorted(found[ids[q]])
        assert all(abs(scores[np.searchsorted(ids, v)] - s) < 1e-9 for _, v, s in own) and [r for r, _, _ in own] == list(range(1, 21))
        hits += len(set(ids[best]) & {v for _, v, _ in own})
        total += 20
    assert hits >= 0.9 * total, hits / total


def test_a_text_is_encoded_in_one_call(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    library, own, calls = Tokenizer.from_file(path), packing.Ids(path), []
    monkeypatch.setattr(own, "_encode", lambda text, encode=own._encode: calls.append(text) or encode(text))
    rng = random.Random(11)
    for _ in range(50):
        parts = ["".join(rng.choices("abcdeñé12.,'*", k=rng.randint(1, 9))) + rng.choice([" ", " ", " ", "\n", "  ", "\t", " "]) for _ in range(200)]
        calls.clear()
        text = "".join(parts)
        assert own.of(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert calls == [text]
    assert packing.coder_of(path) is packing.coder_of(path)


def test_seeds_come_from_stored_windows_and_covered_ones_change_nothing():
    rng = random.Random(13)
    common = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = [" ".join([f"{k}x{rng.randrange(900)}" for _ in range(60)] + (common + [f"{k}y"]) * times + [f"{k}z{rng.randrange(900)}" for _ in range(60)]) for k, times in enumerate((1, 3, 6))]
    bases, kept = [substring.runs(next(substring.words_of([t])), substring.SHINGLE) for t in texts], []
    for base in bases:
        rows = [(int((v[c] ^ substring.U64(j)).view(np.int64)), j, left, c, right) for j in range(substring.HASHES) for v in [substring.hashed(base, j)] for left, c, right in substring.compact_windows(v, 46)]
        key, j, left, c, right = (np.array(x, np.int64) for x in zip(*rows))
        kept.append((rows, substring.in_order(key, (j << 48) | c, (left << 32) | right)))
    for x, y in ((0, 1), (1, 2), (2, 2), (0, 0)):
        seeds = substring.all_seeds(kept[x][1], kept[y][1])
        wanted = {(*a[1:], *b[2:]) for a in kept[x][0] for b in kept[y][0] if a[0] == b[0]}
        assert set(map(tuple, seeds.tolist())) <= wanted and len(seeds)
        found = substring.passages(bases[x], bases[y], seeds)
        # Seeds given twice, or in another order of their functions, lie in passages that are known already.
        assert found and found == substring.passages(bases[x], bases[y], np.concatenate((seeds, seeds)))
        assert all(substring.jaccard(bases[x][s : e - 4], bases[y][t : f - 4]) == v >= 0.8 for s, e, t, f, v in found)


def test_near_copies_with_too_much_of_their_own_are_not_compared(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    original, texts, compared = [word() for _ in range(300)], [], []
    for _ in range(80):
        own = list(original)
        for at in rng.sample(range(5, 295), 3):
            own[at] = word()
        texts.append(own)
    # Two of them have a copy each with one more word.
    texts += [texts[7] + [word()], texts[30] + [word()]]
    own_link = minhash.link

    def link_seen(buckets, verify, *given, **more):
        def counted(pairs):
            compared.append(pairs.count())
            return verify(pairs)

        return own_link(buckets, counted, *given, **more)

    monkeypatch.setattr(minhash, "link", link_seen)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    assert got == {i: {80: 7, 81: 30}.get(i, i) for i in range(82)}
    # The last turn has some 1 800 pairs that agree in enough samples; few of them can be alike.
    assert compared[-1] < 300, compared


def test_tables_that_only_a_search_reads_do_not_outlive_it(spark):
    folder = shared_dir(spark).removeprefix("file://")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, words), (2, words + " nu"), (3, "one two three four\n" + words)], "doc_id bigint, text string")
    earlier = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    kept = minhash.keep_first(linededup.clean(docs))
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - earlier}
    assert "rooted" in left and not {"signed", "bodies", "line-places", "line-bodies"} & left
    assert kept.count() == len({r.text for r in kept.collect()}) >= 1
