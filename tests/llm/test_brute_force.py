"""Text operators and pipeline stages against plain Python, on small and on odd rows."""

from __future__ import annotations

import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from termeval.durable import materialise
from termeval.llm import decontaminate, language, merkle, repeats, shingle_join, surrogates, toxicity, url_trust
from termeval.llm.shared import slices
from tests.llm.test_operators import LONG, ODD, VOCABULARY, frame, words

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(
    not (os.path.isdir(FOLDER) and os.path.exists(VOCABULARY)), reason="driver tables absent"
)


# Fingerprints: likeness is that of the sets of pieces


def test_likeness_counts_shared_pieces(spark):
    rng = random.Random(2)
    rows = [(i, "\n\n".join("\n".join(" ".join(words(rng, 30)) for _ in range(2)) for _ in range(3))) for i in range(6)]
    rows += [(7, rows[0][1]), (8, rows[1][1].replace("t1", "t2"))]
    found = {r.doc_id: r for r in merkle.edits(frame(spark, rows)).collect()}
    assert found[5].near_next < found[5].near_edited
    texts = dict(rows)
    order = sorted(texts)
    for doc, following in zip(order, order[1:] + order[:1]):
        assert (found[doc].near_next == 1.0) == (texts[doc] == texts[following])
        assert 0 <= found[doc].near_next <= 1 and 0.5 < found[doc].near_edited <= 1


# Toxicity: Kneser-Ney in plain Python


def symbols_of(text):
    out = []
    for c in text:
        low = c.lower()
        s = " " if c.isspace() else "0" if unicodedata.category(c)[0] == "N" else low if len(low) == 1 else c
        if not (s == " " and out and out[-1] == " "):
            out.append(s)
    return "".join(out)


def discount(counts):
    once, twice = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
    return once / (once + 2 * twice) if once and twice else 0.75


def kneser_ney(rows):
    """The log ratio of every five-letter n-gram, and of every history for others."""
    counts = {1: Counter(), 0: Counter()}
    for text, label in rows:
        own = " " * 5 + symbols_of(text or "")
        counts[label].update(own[i : i + 5] for i in range(1, len(own) - 4))
    grams = set(counts[0]) | set(counts[1])
    kinds, above = {}, grams
    for k in (4, 3, 2, 1):
        kinds[k] = Counter(g[-k:] for g in above)
        above = set(kinds[k])
    by = {k: discount(kinds[k].values()) for k in kinds}
    total = sum(kinds[1].values())

    def shared(gram):
        k = len(gram)
        if k == 1:
            even = by[1] * len(kinds[1]) / total / (len(kinds[1]) + 1)
            return max(kinds[1][gram] - by[1], 0) / total + even
        same = [n for g, n in kinds[k].items() if g[:-1] == gram[:-1]]
        return (max(kinds[k][gram] - by[k], 0) + by[k] * len(same) * shared(gram[1:])) / sum(same)

    ratios = {}
    for gram in grams:
        value = {}
        for label, own in counts.items():
            d = discount([own[g] for g in grams])
            same = [n for g, n in own.items() if g[:-1] == gram[:-1]]
            rest = d * len(same) / sum(same) if same else 1.0
            value[label] = max(own[gram] - d, 0) / max(sum(same), 1) + rest * shared(gram[1:]), rest
        ratios[gram] = math.log(value[1][0]) - math.log(value[0][0])
        ratios[gram[:-1]] = math.log(value[1][1]) - math.log(value[0][1])
    return ratios


def key_of(gram):
    own = np.array([ord(c) for c in gram.rjust(5)], dtype=np.uint32)
    return int(toxicity.hashes_of(own, len(gram))[0])


LABELLED = [
    ("Bad bad words, 12 BAD!", 1), ("good words  and\nmore", 0), ("ёлка bad", 1), ("a\0b good", 0), ("", 1), (None, 0), ("good", 0),
]


def test_ratios_equal_kneser_ney_in_plain_python(spark):
    df = spark.createDataFrame([(t, 2 * y) for t, y in LABELLED], "text string, part int").repartition(3)
    model = toxicity.model_of(toxicity.count(df), {2}, {0})
    expected = kneser_ney([((t or "").replace("\0", " "), y) for t, y in LABELLED])
    found = {r.key: r.ratio for r in model.ratios.collect()}
    assert found == pytest.approx({key_of(g): x for g, x in expected.items()}, abs=1e-12)


def test_counts_do_not_depend_on_how_much_is_held(spark, monkeypatch):
    rows = [(t, y) for t, y in LABELLED] + [(" ".join(words(random.Random(i), 40, 50)), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, part int").repartition(2)
    expected = sorted(map(tuple, toxicity.count(df).collect()))
    for name, value in (("GATHERED", 10), ("HANDED", 3), ("COUNTED_CHARS", 20)):
        monkeypatch.setattr(toxicity, name, value)
    assert sorted(map(tuple, toxicity.count(df).collect())) == expected


def test_slices_are_as_small_as_asked_for():
    batch = pa.RecordBatch.from_arrays([pa.array(["abcd", None, "abcdef", "a" * 50, "", "abc"])], names=["text"])
    found = [x.column("text").to_pylist() for x in slices(iter([batch]), chars=10)]
    assert found == [["abcd", None, "abcdef"], ["a" * 50], ["", "abc"]]


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_features_equal_sums_of_ratios(spark, monkeypatch, most):
    """Whether the model is sent to the tasks or joined to buckets of texts."""
    monkeypatch.setattr(toxicity, "BROADCAST_RATIOS", most)
    monkeypatch.setattr(toxicity, "BUCKET_BYTES", 100_000)
    df = spark.createDataFrame([(t, 2 * y) for t, y in LABELLED], "text string, part int")
    model = toxicity.model_of(toxicity.count(df), {2}, {0})
    ratios = kneser_ney([((t or "").replace("\0", " "), y) for t, y in LABELLED])
    rows = [*ODD, (50, "bad words and good ёлка 7"), (51, "good " * 30 + "bad")]

    def expected(text):
        own = " " * 5 + symbols_of(text or "")
        grams = [own[i : i + 5] for i in range(1, len(own) - 4)]
        values = [ratios.get(g, ratios.get(g[:-1], 0.0)) for g in grams]
        if not values:
            return [0.0, 0.0, 0.0]
        span = min(toxicity.PASSAGE, len(values))
        best = max(sum(values[i : i + span]) for i in range(max(1, len(values) - span + 1))) / span
        return [sum(values) / len(values), sum(values) / math.sqrt(len(values)), best]

    found = toxicity.features(frame(spark, rows), model, (F.col("doc_id"), F.col("kept").alias("features"))).collect()
    ours = sorted(((r.kept.doc_id is None, r.kept.doc_id or 0, [round(x, 9) for x in r.features]) for r in found))
    short = {d: t for d, t in rows if d != 5}
    theirs = sorted(((d is None, d or 0, [round(x, 9) for x in expected(t)]) for d, t in rows if d in short))
    assert [x for x in ours if x[1] != 5] == theirs and len(ours) == len(rows)


def test_scores_of_an_empty_table(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] * 9, i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    assert toxicity.score(frame(spark, []), toxicity.train(df), (F.col("doc_id"),)).count() == 0


# Decontamination: edit distance of every item and piece


def folded(text):
    kept = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return re.sub(" +", " ", "".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in kept)).strip()


def least_edits(item, text):
    """The edits between ``item`` and the part of ``text`` most like it."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[j - 1] + 1))
    return min(row)


def holds(item, text):
    item, text = folded(item or ""), folded(text or "")
    if len(item) < 12:
        return bool(item) and item == text
    own = np.array([ord(c) for c in item], dtype=np.uint32)
    parts = ["".join(map(chr, x)) for _, x in decontaminate.pieces(own)]
    return any(least_edits(x, text) <= min(int(len(x) * 0.05), (len(x) - 12) // 12) for x in parts)


def test_items_and_parts_equal_edit_distance(spark):
    rng = random.Random(11)
    items = [(i, " ".join(words(rng, n, 900))) for i, n in enumerate((3, 5, 8, 14, 25, 40))]
    items += [(10, "Say hi"), (11, "!?"), (12, None), (13, "")]
    rows = [(1, "say  HI!"), (2, "I say hi"), (3, "!?"), (4, None), (5, ""), (6, "hi")]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", "q", text[at] + "q"])
        return "".join(text)

    for i in range(60):
        item = rng.choice(items[:6])[1]
        at = rng.randrange(max(1, len(item) - 30)) if rng.random() < 0.5 else 0
        part = item[at : at + rng.randrange(30, 130)] if rng.random() < 0.6 else item
        rows.append((100 + i, " ".join(words(rng, 12, 900)) + " " + edited(part, rng.randrange(7)) + ", " + " ".join(words(rng, 5, 900))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.matches(frame(spark, rows), benchmark).collect()
    ours = {(r.doc_id, r.item_id) for r in found}
    theirs = {(d, i) for d, text in rows for i, item in items if holds(item, text)}
    assert ours == theirs and len(theirs) > 20 and (1, 10) in ours
    assert all(0 <= r.start < r.end <= len(dict(rows)[r.doc_id]) for r in found)


def test_edits_that_lie_together_spoil_parts_but_not_the_whole(spark):
    item = " ".join(words(random.Random(4), 30, 900))[:100]
    own = np.array([ord(c) for c in folded(item)], dtype=np.uint32)
    edited = item[:46] + "#1#2#3#4#"[:9:2] + item[51:]
    assert holds(item, edited) and not any(
        least_edits("".join(map(chr, x)), folded(edited)) <= 3 for _, x in decontaminate.pieces(own)[1:]
    )
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame([(1, f"before {edited} after")], "doc_id long, text string"), benchmark)
    assert [r.doc_id for r in found.collect()] == [1]


def test_ninety_letters_of_a_longer_item_are_found_once(spark):
    item = " ".join(words(random.Random(1), 60, 900))
    rows = [(1, "before " + item[70:170] + " after"), (2, item), (3, item + " between " + item), (4, item[:50])]
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.edits) for r in decontaminate.matches(frame(spark, rows), benchmark).collect())
    assert found == [(1, 0), (2, 0), (3, 0), (3, 0)]


def test_an_id_named_like_the_items(spark):
    df = spark.createDataFrame([(1, "the item of the benchmark")], "item_id long, text string")
    assert decontaminate.matches(df, df, id_col="item_id").columns == ["item_id", "item", "start", "end", "edits"]


# Language: out-of-place distances


def profile(texts):
    counts = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            padded = f" {word} "
            counts.update(word)
            counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
            counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][: language.PROFILE]


@pytest.mark.parametrize("most", [2, 4096])
def test_language_equals_out_of_place_distance(spark, monkeypatch, most):
    """With all profiles at once, or in blocks."""
    monkeypatch.setattr(language, "MOST_LANGUAGES", most)
    rng = random.Random(3)
    vocabularies = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["река", "камень", "сад"], "cc": ["über", "straße", "wort"]}
    rows = [(i, " ".join(rng.choices(vocabularies[lang], k=rng.randrange(1, 12))), lang) for i, lang in enumerate(sorted(vocabularies) * 8)]
    training = spark.createDataFrame(rows + [(90, None, "aa"), (91, "", "bb"), (92, "x", None)], "doc_id long, text string, lang string")
    asked = [(1, "lorem straße"), (2, "сад amet река"), (3, "123 !"), (4, None), (5, ""), (6, "́́"), (7, "zzz"), (None, "wort")]
    df = frame(spark, asked).withColumn("text2", F.lit("x"))
    found = language.predict(df, language.profiles(training), keep=(F.col("key").alias("text"), F.col("score").alias("kept"))).collect()
    known = {lang: profile([t for _, t, x in rows if x == lang]) for lang in vocabularies}
    for r, (doc, text) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id)), asked):
        own = profile([text])
        away = {lang: sum(abs(i - ranks.index(g)) if g in ranks else language.PROFILE for i, g in enumerate(own)) for lang, ranks in known.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        assert r.doc_id == doc and r.lang_pred == best
        assert r.score == pytest.approx(1 - away[best] / (language.PROFILE * len(own)) if own else 0.0)


def test_language_of_an_empty_table(spark):
    training = spark.createDataFrame([(1, "word", "aa")], "doc_id long, text string, lang string")
    assert language.predict(frame(spark, []), language.profiles(training)).count() == 0
    nothing = language.predict(frame(spark, ODD), language.profiles(training.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(ODD)


# Surrogates


def test_a_format_that_is_used_up_gets_longer(spark):
    rows = [(i, f"{a}@{b}.co") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")]
    found = {r.doc_id: r.text for r in surrogates.replace(frame(spark, rows), "k").collect()}
    assert len(set(found.values())) == len(rows) and not set(found.values()) & {t for _, t in rows}
    assert all(re.fullmatch(r"[a-z]{2,}@[a-z]\.co", x) for x in found.values())


def remainder(account):
    account = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def fits(card):
    digits = [int(c) for c in card if c.isdigit()]
    return sum((d, 2 * d - 9 if d > 4 else 2 * d)[i % 2 == 0] for i, d in enumerate(digits)) % 10 == 0


def test_check_digits_countries_and_networks_stay(spark):
    accounts = [f"GB82 WEST 1234 5698 7654 {i:02d}" for i in range(30)] + ["DE89370400440532013000"]
    cards = [f"4111 1111 1111 {i:04d}" for i in range(30)]
    nets = ["10.1.2.3", "192.168.7.8", "172.20.1.1", "127.0.0.1"]
    found = {r.doc_id: r.text for r in surrogates.replace(frame(spark, list(enumerate(accounts + cards + nets))), "k").collect()}
    made = [found[i] for i in range(len(found))]
    assert all(remainder(x) == 1 and x[:2] == a[:2] and len(x) == len(a) for x, a in zip(made, accounts))
    assert all(fits(x) and x[0] == "4" and len(x) == 19 for x in made[31:61])
    assert [x.startswith(y) for x, y in zip(made[61:], ("10.", "192.168.", "172.20.", "127."))] == [True] * 4
    assert len(set(made)) == len(made) and not set(made) & {*accounts, *cards, *nets}


def test_a_private_network_that_is_used_up_gives_way(spark):
    """More draws in vain lead to a larger network."""
    df = spark.createDataFrame([("192.168.0.1", 0), ("192.168.0.1", 12), ("192.168.0.1", 24)], "canon string, attempt int")
    shown = [r[0] for r in df.select(surrogates._surrogate("k", F.lit("ip"), F.col("canon"), F.col("attempt"))).collect()]
    assert shown[0].startswith("192.168.") and shown[1].startswith("10.") and all(x.count(".") == 3 for x in shown)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "to ann@site.org", "a", 5), (2, "none", "b", 6)], "doc_id long, text string, _row string, _found int")
    df = df.withColumns({"name": F.lit("n"), "found": F.lit("f"), "shown": F.lit(3), "row": F.lit(None).cast("string")})
    found = sorted(tuple(r)[2:] for r in surrogates.replace(df, "k").collect())
    assert found == [("a", 5, "n", "f", 3, None, 1), ("b", 6, "n", "f", 3, None, 0)]
    assert surrogates.replace(frame(spark, []), "k").count() == 0


# URL trust


def test_distrust_goes_as_far_as_it_can(spark):
    """Fifteen links before a ring of blocked hosts: the value that converges decides."""
    ring = [(i, f"http://r{i}.net/", f'<a href="http://r{(i + 1) % 4}.net/">') for i in range(4)]
    chain = [(10 + i, f"http://c{i}.org/", f'<a href="http://{f"c{i + 1}.org" if i < 14 else "r0.net"}/">') for i in range(15)]
    pages = spark.createDataFrame(ring + chain, "page_id long, url string, html string")
    rules = spark.createDataFrame([("net/", "block")], "rule string, verdict string")
    found = {r.page_id: r.verdict for r in url_trust.judge(pages, rules).collect()}
    # Distrust of each host: its own start and the damped value of the host it links to.
    value = {f"r{i}": 0.15 / (1 - 0.85) for i in range(4)}
    last = value["r0"]
    for i in range(14, -1, -1):
        # A link's share is of the links that lead to its end: r0 is linked twice, all others once.
        last = value[f"c{i}"] = 0.85 * last * (0.5 if i == 14 else 1.0)
    ring_value = {}
    for _ in range(400):
        ring_value = {f"r{i}": 0.15 + 0.85 * ring_value.get(f"r{(i + 1) % 4}", 0.0) for i in range(4)}
    assert all(found[i] == "block" for i in range(4))
    assert [found[10 + i] for i in range(15)] == found_by_hand(pages.collect())


def found_by_hand(pages):
    host = lambda url: url.split("/")[2]
    links = [(host(p.url), host(p.html.split('"')[1])) for p in pages]
    out = Counter(src for src, _ in links)
    start = {host(p.url): 0.15 * p.url.endswith(".net/") for p in pages}
    value = dict(start)
    for _ in range(500):
        value = {h: start[h] + sum(0.85 / out[src] * value[dst] for src, dst in links if src == h) for h in start}
    return ["block" if value[f"c{i}.org"] >= 0.075 else "allow" for i in range(15)]


# Shingle join


def test_copies_without_an_id_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (None, text + " more"), (8, text + " more words"), (9, "other"), (None, None)]
    found = shingle_join.join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.component_id) for r in found if r.n_shingles > 1) == [
        ((False, 5), 5), ((False, 8), 5), ((True, 0), 5),
    ]


def test_a_percent_whose_links_reach_further_is_refused(spark):
    with pytest.raises(ValueError, match="from 67"):
        shingle_join.join(frame(spark, ODD), percent=60)


# Repeated passages


def test_marks_of_any_size_give_the_same_passages(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(words(random.Random(i), 30, 5000))} {passage} {'end ' * (i % 3)}") for i in range(20)]
    found = sorted(map(tuple, repeats.passages(frame(spark, rows)).collect()))
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, repeats.passages(frame(spark, rows)).collect())) == found and len(found) == 20
    assert repeats.passages(frame(spark, [])).count() == 0


def test_texts_of_one_id_have_passages_of_their_own(spark):
    passage = " ".join(f"pé{i}" for i in range(60))
    other = " ".join(f"w{i}" for i in range(80))
    rows = [(1, f"one two {passage} three"), (1, f"{other}\n{passage}"), (2, f"{passage} x"), (2, other[4:]), (3, None), (2, f"{passage} x")]
    found = sorted(map(tuple, repeats.passages(frame(spark, rows)).collect()))
    size = len(passage)
    # The second text of 2 begins within the second word of the first id's.
    assert found == [(1, 2, 60, 8, 8 + size), (1, 2, 138, 6, len(other) + 1 + size), (2, 0, 60, 0, size), (2, 1, 78, 2, len(other) - 4)]


def test_texts_are_dealt_once_for_their_passages(spark, monkeypatch):
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialise(df, label)

    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(repeats, "materialise", kept)
    passage = " ".join(f"p{i}" for i in range(60))
    found = repeats.passages(frame(spark, [(i, f"{'begin ' * i}{passage}") for i in range(4)]))
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert found.count() == 4 and sum(plan.count("Join Inner") for plan in plans) == 1


# Stages of the pipeline, each by its own rule and on odd rows


def documents(spark, rows):
    data = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def text_like(name, n, *edits):
    return " ".join(f"{name}{i}" if i not in edits else f"new{i}" for i in range(n))


STAGED = [*ODD, (20, text_like("a", 90)), (21, text_like("a", 90, 50)), (22, "mail ann@site.org"), (23, "MAIL ann@site.org"), (7, "other text")]


def near_copies(rows, size=5, percent=80):
    """Which rows stay: brute force over all pairs of texts."""
    sets = []
    for _, text in rows:
        own = (text or "").encode().lower().split()
        sets.append({tuple(own[i : i + size]) for i in range(len(own) - size + 1)} or ({tuple(own)} if own else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if x == old else x for x in group]
    key = lambda d: math.inf if d is None else d
    least = {g: min(key(rows[i][0]) for i in range(len(rows)) if group[i] == g) for g in set(group)}
    gone = {rows[i][0] for i in range(len(rows)) if rows[i][0] is not None and sets[i] and least[group[i]] < rows[i][0]}
    return sorted([r for r in rows if r[0] not in gone], key=repr)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


@needs_tables
def test_near_copies_stage_by_brute_force(spark):
    rng = random.Random(9)
    rows = list(STAGED)
    for i in range(40):
        base = text_like(rng.choice("bcd"), rng.choice([60, 90]))
        rows.append((100 + i, " ".join("x" if rng.random() < rng.choice([0, 0.01, 0.05]) else w for w in base.split())))
    found = corpus_pipeline.drop_near_copies(spark, documents(spark, rows).repartition(3), FOLDER)
    assert kept(found) == near_copies(rows)


@needs_tables
def test_benchmark_stage_by_edit_distance(spark):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in STAGED if t != LONG] + [(30, items[0].upper()), (31, f"in {items[1][:110]} between"), (32, items[2][:40])]
    found = corpus_pipeline.drop_benchmark(spark, documents(spark, rows), FOLDER)
    assert kept(found) == sorted([(d, t) for d, t in rows if not any(holds(i, t) for i in items)], key=repr)
    assert {30, 31} & {d for d, _ in kept(found)} == set()


@needs_tables
def test_toxicity_stage_drops_what_the_score_rejects(spark):
    docs = documents(spark, STAGED)
    known = toxicity.labelled(docs.where("false").unionByName(docs), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert known.columns == ["doc_id", "text", "toxic"]
    found = corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    assert found.columns == docs.columns and set(kept(found)) <= set(STAGED)


@needs_tables
def test_personal_data_stage_changes_only_entities(spark):
    found = corpus_pipeline.replace_personal_data(spark, documents(spark, STAGED), FOLDER)
    assert found.columns == documents(spark, []).columns
    ours = kept(found)
    assert [x for x in ours if x[0] not in (22, 23)] == sorted([x for x in STAGED if x[0] not in (22, 23)], key=repr)
    lower, upper = (t for d, t in ours if d in (22, 23))
    assert re.fullmatch(r"mail [a-z]{3}@[a-z]{4}\.org", lower) and upper == "MAIL " + lower[5:]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.collect())


@needs_tables
def test_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), FOLDER).count() == 0


@needs_tables
def test_tokens_of_odd_rows(spark):
    found = corpus_pipeline.encode(spark, documents(spark, STAGED), FOLDER).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(repr(d) for d, _ in STAGED)
    assert all(r.n_tokens == len(r.ids) for r in found)
