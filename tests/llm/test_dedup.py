import random
import re
from itertools import combinations

import numpy as np
import pytest
from brute import components, distance, near
from pyspark.sql import functions as F

from talweg.llm import chosen_path, graph, line_dedup, queries, sentence_spans


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edited(rng, text, times):
    out = list(text)
    for _ in range(times):
        out[rng.randrange(len(out))] = "zz" + str(rng.randrange(99))
    return out


# ---- components


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (3, 2)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(want[n] == c for n, c in got.items())
    assert {x for a, b in edges if a != b for x in (a, b)} == set(got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near duplicates


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    docs, i = [], 0
    for _ in range(25):
        base = words(rng, rng.randint(3, 120))
        for _ in range(rng.randint(1, 8)):
            docs.append((i, " ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 40))))))
            i += 1
    chain = words(rng, 200)
    for _ in range(40):  # each is near the one before it
        chain = edited(rng, chain, 2)
        docs.append((i, " ".join(chain).upper()))
        i += 1
    docs += [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "One  TWO"), (i + 4, "one\u00a0two")]
    rng.shuffle(docs)
    return docs


def test_components_equal_brute_force(spark, copies):
    want, sizes = near(copies)
    got = chosen_path.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_nodes_are_branched(spark, copies, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    want, _ = near(copies)
    got = chosen_path.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.fixture(scope="module")
def templates():
    """One boilerplate with 28 own words keep documents apart (about 0.6), those of 9 link with each other."""
    rng = random.Random(6)
    common = words(rng, 104)
    return [(i, " ".join(common + words(rng, 9 if i % 20 == 7 else 28))) for i in range(400)]


def test_unlinked_pages_of_one_template(spark, templates, monkeypatch):
    """Large nodes that branching does not take apart are compared in blocks, and no link is lost."""
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    monkeypatch.setattr(chosen_path, "LEVELS", 2)
    want, _ = near(templates)
    assert 300 < len(set(want.values())) < 400
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(templates, "doc_id long, text string")).collect()}
    assert got == want


def test_a_family_and_a_few_others_in_a_node(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 16)
    rng = random.Random(16)
    base = words(rng, 120)
    docs = [(i, " ".join(edited(rng, base, 1))) for i in range(120)]
    docs += [(i, " ".join(base[:90] + words(rng, 25))) for i in range(120, 126)]
    want, _ = near(docs)
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_texts_of_one_id(spark):
    rng = random.Random(21)
    one, two = words(rng, 80), words(rng, 80)
    docs = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(edited(rng, one, 1))), (3, " ".join(edited(rng, two, 1))), (4, " ".join(words(rng, 80)))]
    got = {(r.doc_id, r.component_id) for r in chosen_path.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_products_of_incidence_matrices_give_the_same_links():
    rng = np.random.default_rng(3)
    common = rng.integers(1, 2**60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1, 2**60, int(n), dtype=np.uint64)])) for n in rng.integers(5, 40, 60)]
    a, b = map(np.array, zip(*combinations(range(60), 2), strict=True))
    groups = np.arange(60)
    got = chosen_path.linked(a, b, groups, sets)
    want = [k for k in range(len(a)) if chosen_path.alike(sets[a[k]], sets[b[k]])]
    assert components(range(60), [(a[k], b[k]) for k in got]) == components(range(60), [(a[k], b[k]) for k in want])
    assert set(got) <= set(want) and len(set(components(range(60), [(a[k], b[k]) for k in want]).values())) > 1


def test_heavy_nodes_are_confirmed_pair_by_pair(spark, copies, monkeypatch):
    monkeypatch.setattr(chosen_path, "HEAVY", 0)
    want, _ = near(copies)
    got = chosen_path.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_the_exact_bound_is_a_link():
    x = np.arange(100, dtype=np.uint64)
    assert chosen_path.alike(x[:75], x) and not chosen_path.alike(x[:74], x)
    assert not chosen_path.alike(x[:0], x[:0])


def test_odd_rows(spark, odd, none):
    got = chosen_path.near_duplicates(odd[0]).collect()
    assert len(got) == len(odd[1])
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == by[9].component_id == 1 and not by[9].kept
    assert by[3].kept and by[3].n_shingles == 0 and by[5].component_id == 5
    assert by[None].kept and by[None].component_id is None
    assert chosen_path.near_duplicates(none).count() == 0


# ---- lines


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    base = [words(rng, n) for n in (3, 8, 30, 60, 90)]
    docs = []
    for i in range(60):
        some = [" ".join(edited(rng, b, 1) if rng.random() < 0.4 else b) for b in rng.sample(base, 3)]
        some.append(" ".join(words(rng, 12)))
        some.insert(1, rng.choice(["", "---", " ".join(some[0]).upper(), some[0].upper() + "!"]))
        docs.append((i, "\n".join(some)))
    return docs


def normal(line):
    return re.sub(r"[\x00-/:-@\[-`{-\x7F]+", " ", line.lower()).strip(" ")


def test_lines_equal_brute_force(spark, texts):
    """Links by edit similarity alone, over all pairs of lines."""
    df = spark.createDataFrame(texts, "doc_id long, text string")
    norms = {(i, p): normal(x) for i, t in texts for p, x in enumerate(t.split("\n")) if normal(x)}
    assert {(r.doc_id, r.pos): r.norm for r in line_dedup.lines(df).withColumn("norm", line_dedup.normalised(F.col("text"))).collect()} == norms
    distinct = sorted(set(norms.values()))
    links = []
    for a, b in combinations(distinct, 2):
        longer = max(len(a), len(b))
        if min(len(a), len(b)) >= 0.9 * longer and distance(a, b) <= int(0.1 * longer):
            links.append((a, b))
    assert links
    group = components(distinct, links)
    first = {}
    for k in sorted(norms):
        first.setdefault(group[norms[k]], k)
    want = {i: [x for p, x in enumerate(t.split("\n")) if (i, p) not in norms or first[group[norms[i, p]]] == (i, p)] for i, t in texts}
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(df).collect()}
    missed = [x for i in want for x in got[i] if x not in want[i]]
    assert all(x in got[i] for i in want for x in want[i])  # nothing else goes
    assert len(missed) <= 0.02 * (len(norms) - sum(map(len, want.values())))  # single letters, which few hashes tell apart


def one_letter(rng, base):
    out, k = list(base), rng.randrange(len(base))
    at = rng.randrange(len(out[k]))
    out[k] = out[k][:at] + rng.choice("vwxyz") + out[k][at + 1 :]
    return out


def some_words(rng, base):
    out = list(base)
    for k in rng.sample(range(len(out)), max(1, round(0.07 * len(out)))):
        out[k] = "".join(rng.choice("stuvwxyz") for _ in range(len(out[k])))
    return out


def one_more(rng, base):
    out = list(base)
    out.insert(rng.randrange(len(out) + 1), "".join(rng.choice("stuvwxyz") for _ in range(3)))
    return out


@pytest.mark.parametrize("change", [one_letter, some_words, one_more])
def test_recall_against_edit_similarity_alone(spark, change):
    """Pairs within the 10 %: nine of ten are found at every length, whatever their SimHashes."""
    rng, rows, sizes = random.Random(8), [], (5, 8, 12, 20, 30, 60, 150)
    while len(rows) < 200 * len(sizes):
        base = words(rng, sizes[len(rows) // 200])
        a, b = " ".join(base), " ".join(change(rng, base))
        if 0 < distance(a, b) <= int(0.1 * max(len(a), len(b))):
            rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = [r.doc_id for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("lines_.emptied").select("doc_id").collect()]
    assert all(i % 2 for i in gone)
    assert all(sum(i // 200 == k for i in gone) >= 90 for k in range(len(sizes))), [sum(i // 200 == k for i in gone) for k in range(len(sizes))]


def test_digits_count_as_letters(spark):
    rows = [(1, "Total due 15 DA"), (2, "Total due 99 DA"), (3, "total due: 15 DA!")]
    got = {r.doc_id: r.lines_.emptied for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_lines_of_the_same_words_in_other_orders(spark):
    rng = random.Random(14)
    base = words(rng, 24)
    rows = [(i, " ".join(rng.sample(base, len(base)))) for i in range(60)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == dict(rows)


def test_own_columns_of_the_operators_names(spark):
    df = spark.createDataFrame([(1, "a line of some words\nanother one"), (2, "a line of some words")], "doc_id long, text string").withColumn("lines_", F.lit("mine"))
    got = line_dedup.dedup(df)
    assert got.columns == ["doc_id", "text", "lines_", "lines__"]
    assert {r.doc_id: (r.lines_, r.lines__.emptied) for r in got.collect()} == {1: ("mine", False), 2: ("mine", True)}


def test_long_lines_with_many_edits(spark):
    rng = random.Random(5)
    base = words(rng, 4000)
    other, far = ([x + "yyy" if rng.random() < share else x for x in base] for share in (0.06, 0.3))
    rows = [(i, " ".join(x)) for i, x in enumerate((base, other, far))]
    assert len(rows[1][1]) - len(rows[0][1]) > 500 and len(rows[2][1]) > 1.1 * len(rows[0][1])
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("lines_.emptied").collect()
    assert [r.doc_id for r in got] == [1]


def test_a_family_of_alike_lines(spark):
    rng = random.Random(1)
    base = words(rng, 400)
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(80)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "lines_.*").collect()
    assert sum(r.removed for r in got) > 60 and sum(r.emptied for r in got) == sum(r.removed for r in got)


def test_alike_lines_that_share_a_very_common_block_alone(spark):
    """Lines of 29 words fall into six blocks; a hundred lines have the same words in one of them. Two of these lines are alike, but
    differ in each of the other blocks: they meet over the common one only."""
    rng = random.Random(4)
    vocabulary = list(dict.fromkeys("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6000)))
    pairs = [(w, w[:-1] + "z") for w in vocabulary]
    block = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 9), F.lit(6)).cast("int")
    known = spark.createDataFrame(pairs, "w string, z string").select("w", "z", block("w").alias("b"), block("z").alias("bz")).collect()
    common = [r.w for r in known if r.b == 0][:4]
    of = [[r for r in known if r.b == b and r.bz > 0] for b in range(1, 6)]
    some = [x[:5] for x in of]
    line = [r.w for b in some for r in b]
    other = [r.z if i == 0 else r.w for b in some for i, r in enumerate(b)]
    far = [[rng.choice([r.w for r in of[b]]) for b in range(5) for _ in range(5)] for _ in range(100)]
    texts = [*far[:50], line, other, *far[50:]]
    rows = [(i, " ".join([*common, *x])) for i, x in enumerate(texts)]
    assert distance(rows[50][1], rows[51][1]) == 5 <= 0.1 * len(rows[50][1])
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).filter("lines_.emptied").collect()
    assert [r.doc_id for r in got] == [51]


def test_edit_distance_of_what_lines_do_not_share(spark):
    """Against plain edit distances: words put in, left out, repeated and replaced at either end and between."""
    rng, rows = random.Random(6), []
    for _ in range(300):
        base = [rng.choice(("a", "bb", "ab", "abc", "cab")) for _ in range(rng.randint(1, 14))]
        out = list(base)
        for _ in range(rng.randint(0, 2)):
            at = rng.choice((0, len(out), rng.randint(0, len(out))))
            out[at : at + rng.randint(0, 1)] = rng.choice(([], ["a"], ["bb", "a"], base[:1]))
        if out:
            rows.append((" ".join(base), " ".join(out)))
    texts = [(i, t) for i, t in enumerate(t for r in rows for t in r)]
    pairs = [(2 * i, 2 * i + 1) for i in range(len(rows))]
    got = line_dedup.confirmed(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(texts, "line long, norm string"))
    want = {2 * i for i, (x, y) in enumerate(rows) if distance(x, y) <= int(0.1 * max(len(x), len(y)))}
    assert {r.a for r in got.collect()} == want and 0 < len(want) < len(rows)


def test_odd_lines(spark, odd, none, tmp_path):
    got = line_dedup.dedup(odd[0])
    assert got.columns == [*odd[0].columns, "lines_"]
    rows = got.collect()
    assert len(rows) == len(odd[1])
    by = {r.doc_id: r for r in rows}
    assert by[10].text == "one\ntwo" and by[10].lines_.removed == 3 and not by[10].lines_.emptied
    assert by[2].text == "" and by[2].lines_.emptied and by[1].text
    assert by[3].text is None and by[4].text == "" and not by[4].lines_.emptied and by[5].text == " \n\t\n "
    assert by[None].text and by[8].text
    assert line_dedup.dedup(none).count() == 0
    odd[0].write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op2_line_dedup(spark, str(tmp_path)).columns == ["doc_id", "n_lines", "n_removed", "text"]


# ---- spans


def sentence(rng, n):
    return " ".join(words(rng, n)) + rng.choice([". ", "! ", "?\n"])


def test_passages_stay_in_their_first_document_only(spark):
    rng = random.Random(12)
    passage = "".join(sentence(rng, rng.randint(4, 11)) for _ in range(9)).strip()
    unpunctuated = " ".join(words(rng, 90))
    docs = []
    for i in range(30):
        own = [sentence(rng, rng.randint(3, 14)) for _ in range(8)]
        if i % 3 == 0:
            own.insert(rng.randint(0, 8), passage + " ")
        if i % 5 == 0:
            own.insert(rng.randint(0, 8), " ".join(words(rng, 3)) + " " + unpunctuated + " " + sentence(rng, 4))
        docs.append((i, "".join(own)))
    got = {r.doc_id: r for r in sentence_spans.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        assert (passage in got[i].text) == (i == 0)
        run = unpunctuated.split()
        longest = max((n for n in range(0, 91, 6) if any(" ".join(run[k : k + n]) in got[i].text for k in range(91 - n))), default=0)
        assert (longest >= 84) if i == 0 else (longest < 25)
        if i % 3 and i % 5:
            assert got[i].text == text and got[i].n_removed == 0
        assert got[i].text == "".join(c for k, c in enumerate(text) if not any(s.start <= k < s.end for s in got[i].removed))


def plain_spans(docs):
    """Removed pieces of each document by definition, over whole texts: (doc_id, text) -> words that stay."""
    pieces = {}
    for i, t in docs:
        read = sentence_spans.Words([t.lower().encode()])
        first, end = sentence_spans.sentences(read)
        words_ = t.lower().split()
        pieces[i] = [words_[a:b] for a, b in zip(first, end, strict=True)]
    seen, gone = {}, {i: set() for i, _ in docs}
    for i in sorted(pieces):
        for k in range(len(pieces[i])):
            to = next((m for m in range(k + sentence_spans.RUN, len(pieces[i]) + 1) if sum(map(len, pieces[i][k:m])) >= sentence_spans.LEAST), None)
            if to is not None and seen.setdefault(tuple(sum(pieces[i][k:to], [])), (i, k)) != (i, k):
                gone[i].update(range(k, to))
    return {i: [w for k, p in enumerate(pieces[i]) if k not in gone[i] for w in p] for i in pieces}


def test_spans_equal_brute_force(spark):
    rng = random.Random(31)
    vocabulary = words(rng, 300)
    passages = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "!"]) for _ in range(rng.randint(51, 80))) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "?"]) for _ in range(rng.randint(5, 60))) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), rng.choice(passages))
        docs.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rng.shuffle(docs)
    got = {r.doc_id: r for r in sentence_spans.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = plain_spans(docs)
    assert {i: got[i].text.lower().split() for i, _ in docs} == want
    assert all(got[i].n_removed == 0 for i, _ in docs if i % 2 == 0)  # clean ones are left alone
    held = [(i, p) for i, t in sorted(docs) for p in passages if p in t]
    first = {p: min(i for i, q in held if q == p) for p in passages if any(q == p for _, q in held)}
    left = [len(p.split()) - (len(t.split()) - len(got[i].text.split())) for i, t in docs for p in passages if p in t and first[p] != i]
    assert left and max(left) <= 26 and sum(left) / len(left) < 10  # of 51 to 80 words: what stands before the first and after the last cut


def test_short_sentences_after_unended_text(spark):
    """A passage of three sentences of 17 words each, alone and behind text that does not end."""
    rng = random.Random(44)
    vocabulary = words(rng, 400)
    for _ in range(5):
        passage = " ".join(" ".join(rng.choice(vocabulary) for _ in range(17)) + "." for _ in range(3))
        docs = [(1, passage), (2, " ".join(rng.choice(vocabulary) for _ in range(9)) + " " + passage + " and so on")]
        got = {r.doc_id: r for r in sentence_spans.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got[1].n_removed == 0 and got[2].n_removed > 0 and len(got[2].text.split()) < 40


def test_odd_spans(spark, odd, none):
    got = sentence_spans.dedup(odd[0]).collect()
    assert len(got) == len(odd[1])
    by = {r.doc_id: r for r in got}
    assert by[1].text == odd[1][0][1] and by[2].text.strip() == "" and by[3].text == "" and by[5].text == " \n\t\n "
    assert by[7].text == "x" * 200_000
    assert sentence_spans.dedup(none).count() == 0


def test_repeats_within_one_document(spark):
    rng = random.Random(3)
    block = "".join(sentence(rng, 8) for _ in range(4))
    out = sentence_spans.dedup(spark.createDataFrame([(1, block + "Something else entirely. " + block)], "doc_id long, text string")).first()
    assert out.text.count(block.split(".")[0].split("!")[0].split("?")[0]) == 1 and "Something else" in out.text
