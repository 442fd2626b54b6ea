"""Training-data operators against brute force, exact round trips and defined edge cases."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import consensus, encoding, leakage, overlap, pagespam, pairs, splits, text, truncation

MODEL = f"{encoding.TOKENIZER_DIR}/byte_bpe_50k.json"


# 1 -- cut-off values


@pytest.mark.parametrize(
    "value, kind",
    [
        ("It ends here.", "closed"), ("A link. See https://a.example/report", "word"), ("Cut in the mid", "bare"), ("One is done. Two is", "tail"), ("```\nx = 1", "open"),
        ("```\nx = 1\n```", "closed"), ("He said “so it", "open"), ("Text (See rubric, section 1", "open"), ("Done. (See rubric, section 1)", "closed"), ("So the wor�", "scar"),
        ("the gate was be <b", "scar"), ("| a | b |\n|---|---|\n| c | d |", "closed"), ("| a | b |\n|---|---|\n| c", "open"), ("All done. 🙂", "closed"), ("It holds. [3]", "closed"),
        ("Fine.\n\nKind regards,\nNel", "word"), ("   ", "closed"), ("Why?\nAnswer:", "closed"), ('{"label": 1, "j": "The', "open"), ("x" * 100_000 + ".", "closed"), ("It was kept by Mr.", "short form"), ("Kept by the guild, see vol.", "short form"),
    ],
)
def test_endings(value, kind):
    assert truncation.ending(value)[0] == kind


def test_truncation_edge_cases(spark):
    cols = "attack_id long, answer string, judge_justification string, source string, key string, text string"
    assert truncation.find_truncated(spark.createDataFrame([], cols)).count() == 0
    rows = [(1, "First one. Then it", None, None, "k", "t"), (1, "First one. Then it", None, None, "k", "t"), (2, None, "", "s", "k", "t"), (3, "Done.", "Fine [", "s", None, None)]
    got = {(r.attack_id, r.field) for r in truncation.find_truncated(spark.createDataFrame(rows, cols)).collect()}
    assert got == {(1, "answer"), (3, "judge_justification")}
    rates = truncation.truncation_rates(spark.createDataFrame(rows, cols)).collect()
    assert {(r.source, r.field): r.n_truncated for r in rates}[None, "answer"] == 1


def test_limits_need_no_minimum_and_are_moved_by_complete_values():
    import pandas as pd

    def limits(at, n, cut):
        rng = np.random.default_rng(2)
        x, c = np.unique(np.clip(rng.normal(60, 15, 400), 20, 99).astype(int), return_counts=True)
        h = pd.DataFrame({"source": "s", "field": "f", "unit": "chars", "length": [*x, at], "n": [*c, n], "cut": [*[0] * len(x), cut]})
        return dict(truncation.limits_of(h)[["length", "posterior"]].values.tolist())

    assert limits(128, 300, 297)[128] > 0.95 and limits(128, 6, 6)[128] > 0.5
    assert limits(128, 300, 0) == {} and limits(128, 300, 4).get(128, 0) < 0.05 and limits(12, 5, 5)[12] > 0.4


def test_a_value_that_only_its_length_shows_to_be_cut(spark):
    rows = [(i, "It was seen by the keepers of the mill in 17%02d. Then the lamp we" % i, "s") for i in range(40)]
    rows += [(100 + i, "A note on the mill. " * (1 + i % 7) + "The end.", "s") for i in range(200)]
    # as long as the others; an initial with its full stop ends a sentence or is cut inside a name
    short = "It was seen by the keepers of the old mill, and then by a Mr. A."
    rows += [(900, short, "s"), (901, short[:30] + " Mr. A.", "s")]
    assert len(short) == len(rows[0][1])
    got = {r.attack_id: r for r in truncation.find_truncated(spark.createDataFrame(rows, "attack_id long, answer string, source string"), ("answer",)).collect()}
    assert {*range(40)} | {900} == set(got) and got[900].log_odds <= got[900].length_odds


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(5, 0.6, 20000))
    cut = x[x < 200].round()
    v, n = np.unique(cut, return_counts=True)
    mu, sd = truncation.lognormal_censored(v, n.astype(float), 200, float((x >= 200).sum()))
    assert mu == pytest.approx(5, abs=0.05) and sd == pytest.approx(0.6, abs=0.05)


# 2 -- splits


def records(spark, n, seed):
    rng = random.Random(seed)
    ent = lambda: rng.choice([None, "n/a", "The Élan Mill", "elan-mill", "ELAN MILL.", *[f"Place {rng.randrange(n)}" for _ in range(4)]])
    rows = [(f"r{i:03d}", ent(), (rng.choice([None, "tbd", *[f"What of {{e}} {rng.randrange(n)}?" for _ in range(3)]]),), "ab"[i % 2]) for i in range(n)]
    return rows + rows[:3], spark.createDataFrame(rows + rows[:3], "id string, entity string, metadata struct<template:string>, category string")


def test_groups_against_union_find(spark):
    rows, df = records(spark, 80, 4)
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, e, (t,), _ in rows:
        for k in (("e", text.entity_key(e)), ("t", text.template_key(t))):
            if k[1]:
                parent[find(("i", i))] = find(k)
    groups: dict = {}
    for i, *_ in rows:
        groups.setdefault(find(("i", i)), set()).add(i)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {(r.id_a, r.id_b) for r in splits.group_pairs(df).collect()} == want
    rec = splits.split_records(df).collect()
    assert len(rec) == 80 and len({(r.root, r.assigned) for r in rec}) == len({r.root for r in rec})


def test_splits_of_singletons_keep_proportions(spark):
    df = spark.createDataFrame([(f"{i:03d}", None, (None,), "ab"[i % 2]) for i in range(200)], "id string, entity string, metadata struct<template:string>, category string")
    got = {r.assigned: r.records for r in splits.split_report(df).collect()}
    assert got == {"train": 160, "validation": 20, "test": 20}
    assert splits.split_report(df.limit(0)).count() == 0


def test_lanes_keep_labels_balanced(spark):
    rng = random.Random(9)
    rows = [(f"{i:05d}", f"Place {i // rng.randrange(1, 4)}", (None,), rng.choices("abcd", (60, 25, 12, 3))[0]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, entity string, metadata struct<template:string>, category string")
    groups = splits.related_groups(df)
    for lane in (10_000, 300):
        placed = splits.assign_splits(df.select("id", "category"), groups, "category", lane_records=lane)
        got = groups.join(placed, "root").join(df.select("id", "category").distinct(), "id").groupBy("split", "category").count().collect()
        total = {c: sum(r["count"] for r in got if r.category == c) for c in "abcd"}
        for want, split in ((0.8, "train"), (0.1, "validation"), (0.1, "test")):
            assert all(abs(sum(r["count"] for r in got if r.category == c and r.split == split) / total[c] - want) < 0.06 for c in "abcd")
    assert all(r.label_gap < 0.05 for r in splits.split_report(df).collect())


# 3 -- pairs


@pytest.mark.parametrize(
    "q, a, want",
    [
        ("How deep is it?", None, ["empty"]), ("How deep is it?", " ​", ["empty"]), ("How deep is it?", "[no answer]", ["empty"]), ("How deep is it?", "None", []), ("How deep is it?", "0", []),
        ("How deep is the old mill?", "I'm sorry, but I can't help with that. I hope you understand.", ["refusal"]), ("How deep is it?", "There is no such mill; the premise is false.", []),
        ("How deep is it?", "I cannot vouch for the ledger, yet every copy has 12 for it.", []), ("How deep is the old mill?", "Question: How deep is the old mill?", ["copies_question"]),
        ("How deep is the old mill?", "You asked: “How deep is the old mill?” It is 12.", []), ("How deep is the old mill of the town?", "Les sources donnent 12 pour le moulin et la porte de la ville.", ["other_language"]),
        ("How deep is the mill? Please answer in French.", "Les sources donnent 12 pour le moulin et la porte de la ville.", []), (None, "It is 12.", []), ("How deep is it?", "word " * 50_000, []),
    ],
)
def test_pair_rules(q, a, want):
    assert pairs.defects_of(q, None, a) == want


@pytest.mark.parametrize(
    "q, a, copy",
    [
        ("Sihodar Lighthouseの最も古い図面を描いたのは誰ですか？", "SIHODAR LIGHTHOUSEの最も古い図面を描いたのは誰ですか？\n", True), ("Sihodar Lighthouseの最も古い図面を描いたのは誰ですか？", "Sihodar Lighthouseの最も古い図面を描たのは誰ですか", True),
        ("Tamor Mill의 이름은 무엇인가요?", "tamor mill의 이름은 무엇인가요", True), ("Who is it?", "who is it", True), ("Who is it?", "Who is", False), ("Sihodar Lighthouseの最も古い図面を描いたのは誰ですか？", "Nel", False), ("?!", "?!", False),
        ("Sihodar Lighthouseの最も古い図面を描いたのは誰ですか？", "Sihodar Lighthouseの図面はNelが作成しました", False),
    ],
)
def test_copies_of_any_script_and_length(q, a, copy):
    assert text.copies_question(a, [q, None]) == copy


#: Refusals and answers written apart from the patterns, for a measure in each language.
HELD_OUT = {
    "zh": (["很抱歉，我无法回答这个问题。", "对不起，我不能提供这方面的信息。请咨询专业人士。", "我无法协助您完成此请求。", "恕我不能回答。"], ["这座桥建于1801年。", "记录显示答案是铁门。"]),
    "ar": (["عذرا، لا يمكنني الإجابة على هذا السؤال.", "لا أستطيع مساعدتك في ذلك.", "أعتذر، هذا خارج نطاق عملي.", "أنا غير قادر على تقديم إجابة."], ["بني الجسر عام 1801.", "الإجابة هي البوابة الحديدية."]),
    "ko": (["죄송합니다. 이 질문에는 답변할 수 없습니다.", "그 요청은 도와드릴 수 없습니다.", "죄송하지만 알려드릴 수 없습니다.", "답변드리기 어렵습니다."], ["다리는 1801년에 지어졌다.", "정답은 철문이다."]),
    "hi": (["क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।", "मैं इसमें मदद नहीं कर सकता।", "मुझे खेद है, मैं उत्तर देने में असमर्थ हूँ।"], ["पुल 1801 में बना था।", "उत्तर लोहे का द्वार है।"]),
    "nl": (["Het spijt me, maar deze vraag kan ik niet beantwoorden.", "Helaas kan ik u hier niet mee helpen.", "Daar kan ik geen antwoord op geven."], ["De brug werd in 1801 gebouwd.", "Dat kan niet kloppen; het was een ijzeren poort."]),
    "pl": (["Przykro mi, nie mogę odpowiedzieć na to pytanie.", "Niestety nie mogę w tym pomóc.", "Nie jestem w stanie udzielić odpowiedzi."], ["Most zbudowano w 1801 roku.", "To była żelazna brama."]),
    "tr": (["Üzgünüm, bu soruya cevap veremem.", "Maalesef bu konuda yardımcı olamam.", "Bu soruyu yanıtlayamam."], ["Köprü 1801 yılında yapıldı.", "Cevap demir kapıdır."]),
    "ja": (["申し訳ありませんが、その質問にはお答えできません。", "お手伝いできません。"], ["橋は1801年に建てられました。"]),
}


@pytest.mark.parametrize("lang", sorted(HELD_OUT))
def test_refusals_of_many_languages(lang):
    refusals, answers = HELD_OUT[lang]
    assert sum(map(pairs.is_refusal, refusals)) / len(refusals) >= 0.75 and not any(map(pairs.is_refusal, answers))


def test_copies_may_come_any_number_of_times():
    q = "How deep is the old mill of the town?"
    assert text.copies_question(" ".join([q] * 60), [q, None]) and not text.copies_question(" ".join([q] * 30 + ["It is twelve metres deep at the wheel."] * 30), [q, None])
    assert text.copies_question("Who isn it?", ["Who isn't it?", None]) or not text.copies_question("Nel Tamor", ["Who is it?", None])


def test_pair_frame(spark):
    cols = "attack_id long, perturbed_question string, original_question string, answer string, source string, judge_label int"
    assert pairs.broken_pairs(spark.createDataFrame([], cols)).count() == 0
    df = spark.createDataFrame([(1, "q", "q", None, "s", 0)] * 2 + [(2, None, None, "One. Two is", "s", None)], cols)
    assert {(r.attack_id, r.defect) for r in pairs.broken_pairs(df).collect()} == {(1, "empty"), (2, "truncated")}


# 4 -- overlap

Q = "In the Rovek Ledger, how many keepers looked after Tamor Mill in 1801?"


@pytest.mark.parametrize(
    "other, same",
    [
        (Q, True), ("in the rovek ledger, how many keepers looked after tamor mill in 1801? Thanks.", True), ("How many keepers looked after Tamor Mill in 1801, per the Rovek Ledger?", True),
        ("In the Rovek Ledger, how many keepres looked aftr Tamor Mill in 1801?", True), ("Can you help? Question 7. " + Q, True), ("12) " + Q, True), (Q.replace("1801", "7"), False), (Q.replace("1801", "1802"), False), (Q.replace("Tamor", "Belun"), False), (Q.replace("Rovek", "Sumil"), False),
        ("In the Rovek Ledger, which town lies closest to Tamor Mill in 1801?", False), (None, False), ("?!", False),
    ],
)
def test_same_question(spark, other, same):
    df = spark.createDataFrame([("a", Q, "train", 1), ("b", other, "test", 1), ("c", Q, None, 2), ("a", Q, "train", 1)], "id string, question string, split string, text int")
    assert [(r.id_a, r.id_b) for r in overlap.ordered_pairs(overlap.cross_split_pairs(df)).collect()] == ([("a", "b")] if same else [])


@pytest.mark.parametrize("other", ["Can you help " + Q.upper(), Q.upper() + " Thanks", Q.upper().replace("IN THE", "iN THE")])
def test_capitals_with_a_word_in_another_case(spark, other):
    usual = ["In the Rovek Ledger, how many keepers looked after Belun Mill in 1801?", "In the Rovek Ledger, which keepers looked after Sumil Mill in 1700?"]
    df = spark.createDataFrame([("a", Q, "train"), ("b", other, "test"), *[(f"t{i}", x, "train") for i, x in enumerate(usual)]], "id string, question string, split string")
    assert [(r.id_a, r.id_b) for r in overlap.ordered_pairs(overlap.cross_split_pairs(df)).collect()] == [("a", "b")]


def test_slips_in_both_names(spark):
    q = "According to the Kitigisen Survey, which town lies closest to Jodinesk Codex?"
    df = spark.createDataFrame([("a", q, "train"), ("b", q.replace("Kitigisen", "Kitgisen").replace("Jodinesk", "Jodineks"), "test"), ("c", q.replace("Kitigisen", "Molapesen"), "test")], "id string, question string, split string")
    assert [(r.id_a, r.id_b) for r in overlap.ordered_pairs(overlap.cross_split_pairs(df)).collect()] == [("a", "b")]


def test_rewordings_are_learned_from_answers_and_coverage_decides(spark):
    rows = []
    for i, name in enumerate(("Tamor", "Belun", "Sumil", "Korav", "Devis", "Wulak")):
        ask = f"In the Rovek Ledger, how many keepers looked after {name} Mill?"
        rows += [(f"a{i}", ask, "train", str(100 + i)), (f"b{i}", ask.replace("keepers looked after", "wardens cared for"), "test", str(100 + i) if i else None)]
        rows += [(f"c{i}", ask.replace("keepers looked after", "visitors came to"), "test", str(700 + i))]
    df = spark.createDataFrame(rows, "id string, question string, split string, ground_truth string")
    pairs_of = lambda d, **k: {(r.id_a, r.id_b) for r in overlap.ordered_pairs(overlap.cross_split_pairs(d, **k)).collect()}
    assert pairs_of(df) == {(f"a{i}", f"b{i}") for i in range(6)}
    assert pairs_of(df, answer=None) == set()
    assert len(pairs_of(df, coverage=0.0)) == 12


def test_large_shards_are_cut_into_blocks(spark, monkeypatch):
    rows = [(f"r{i:02d}", Q + " please" * (i % 5) + " thanks" * (i // 5), "train" if i % 3 else "test") for i in range(30)]
    df = spark.createDataFrame(rows, "id string, question string, split string")
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in rows for b in rows if a[2] == "test" and b[2] == "train"}
    for size in (2_000, 3):
        monkeypatch.setattr(overlap, "BLOCK_TEXTS", size)
        assert {(r.id_a, r.id_b) for r in overlap.ordered_pairs(overlap.cross_split_pairs(df)).collect()} == want
    n = {r.eval_id: r.n_train_records for r in overlap.overlapping_records(df.withColumn("ground_truth", F.lit(None).cast("string"))).collect()}
    assert set(n.values()) == {20} and len(n) == 10


def test_near_is_damerau():
    assert overlap.near("keepers", "keepres") and overlap.near("works", "wroks") and not overlap.near("tamor", "belun") and not overlap.near("ab", "ac")


# 5 -- consensus


def test_consensus_beats_majority(spark):
    rng = np.random.default_rng(3)
    truth = rng.choice(4, 600, p=[0.5, 0.2, 0.2, 0.1])
    shift = lambda t: (t + 1) % 4
    people = {"a": 0.9, "b": 0.85, "c": 0.6, "d": "shift", "e": "shift"}
    human = [(f"i{i}", p, int(shift(t) if acc == "shift" and rng.random() < 0.9 else t if acc != "shift" and rng.random() < acc else rng.integers(4)), i) for i, t in enumerate(truth) for p, acc in people.items()]
    j = spark.createDataFrame([(f"i{i}", "x+y", None, None) for i in range(600)], "item_id string, judge_model string, individual_judgments array<struct<label:int,confidence:double,justification:string,failed:boolean>>, agreement_rate double")
    h = spark.createDataFrame(human, "item_id string, annotator string, human_label int, labelled_at int")
    items, ann = consensus.consensus(j, h)
    got = {r.item_id: r.label for r in items.collect()}
    acc = np.mean([got[f"i{i}"] == t for i, t in enumerate(truth)])
    assert acc > 0.85
    rel = {r.annotator: r.reliability for r in ann.collect()}
    assert rel["human:a"] > 0.8 > 0.4 > rel["human:d"]


def test_fit_ends_at_a_stationary_point_of_the_dual(spark):
    rng = np.random.default_rng(7)
    truth = rng.choice(4, 300)
    pats = [sorted(4 * a + (int(t) if rng.random() < acc else int(rng.integers(4))) for a, acc in enumerate((0.9, 0.8, 0.5, 0.3)) if rng.random() < 0.8) for t in truth]
    df = spark.createDataFrame([(p, 1) for p in pats if p], "pattern array<int>, n long")
    got = consensus.fit(df, 4)
    assert got.change < consensus.TOLERANCE and got.rounds > 3
    assert all(b >= a - 1e-6 for a, b in zip(got.objective, got.objective[1:]))
    value = lambda s: consensus.one_round(df, s, got.prior, consensus.BETA)[0] - 0.5 * consensus.ALPHA * (s**2).sum()
    best = value(got.sigma)
    for a, c, k in ((0, 0, 0), (1, 2, 1), (3, 3, 0)):
        for d in (-0.2, 0.2):
            s = got.sigma.copy()
            s[a, c, k] += d
            assert value(s) < best


def test_votes_rules(spark):
    j = spark.createDataFrame(
        [("i", "x+y+z", [(1, 0.5, "", None), (2, 0.0, "Error: timeout", None), (3, 0.5, "", True)])] * 2,
        "item_id string, judge_model string, individual_judgments array<struct<label:int,confidence:double,justification:string,failed:boolean>>",
    )
    h = spark.createDataFrame([("i", "a", 1, 1), ("i", "a", 2, 2), ("i", "b", 9, 1), ("z", "a", 1, 1), (None, "a", 1, 1)], "item_id string, annotator string, human_label int, labelled_at int")
    assert {tuple(r) for r in consensus.all_votes(j, h).collect()} == {("i", "judge:x", 1), ("i", "human:a", 2)}
    assert consensus.consensus(j.limit(0).withColumn("agreement_rate", F.lit(1.0)), h)[0].count() == 0


# 6 -- encoding


@pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary not there")
def test_encoding_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(MODEL)
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", "Hello world", " " * 5000, "a" * 5000, "日本語🙂 x" * 50, "<|endoftext|>", "\t \n\r", *["".join(chr(rng.choice([32, 97, 98, 101, 233, 0x4E00, 0x1F642, 10])) for _ in range(200)) for _ in range(30)]]
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)] + [(999, None, "z"), (1, "Hello world", "z")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encoding.encode_corpus(df).collect()}
    assert got.pop(999) == [] and got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)}


# 7 -- leaks

PASSAGE = "Twice Wizo Fogox swore before 295 students that no oak wheel had ever left Vufisos, and twice the inventory proved otherwise. Half of the tin came back in 1664."
ASK = "Who among the 26 divers at Port Mupig first noticed that the notebook of Zujok had been swapped?"


@pytest.mark.parametrize(
    "doc, hit",
    [
        (f"Intro. {PASSAGE} End.", True), (f"x {ASK.upper()} y", True), (f"x <p>{PASSAGE[:70].replace('swore', '<em>swore</em>')}</p> y", True), ("> Twice Wizo Fogox swore\n> before 295 stu-\n> dents that no oak wheel had ever left\n> Vufisos", True),
        (PASSAGE.replace("Wizo Fogox", "Bela Kunor").replace("295", "311").replace("Vufisos", "Monate").replace("1664", "1720"), False), ("no oak wheel had ever left Vufisos", False), ("Wizo Fogox", False), (None, False), ("", False),
    ],
)
def test_leaks(spark, doc, hit):
    items = spark.createDataFrame([("e1", ASK, PASSAGE), ("e2", None, None)], "item_id string, question string, passage string")
    docs = spark.createDataFrame([(1, doc, "x"), (1, doc, "x")], "doc_id long, text string, item_id string")
    got = leakage.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == ({(1, "e1")} if hit else set())
    for r in got:
        assert 0 <= r.start < r.end <= len(doc)


PLAIN = "when the lamp of the old tower was lit again the fishermen of the lower village had long since sold their nets and left the quay"
JA = "古い塔の灯台に再び火がともされたとき、下の村の漁師たちはすでに網を売り払い、波止場を去っていた。"


@pytest.mark.parametrize(
    "items, doc, want",
    [
        ([("e1", None, PLAIN, None)], f"Intro of a page. {PLAIN}. The end.", {"e1"}), ([("e1", None, PLAIN, None)], "The lamp of the old tower was new and the quay was empty.", set()),
        ([("e1", "Who wrote Dune?", None, "Frank")], "A quiz. Who wrote Dune? Nobody knew.", {"e1"}), ([("e1", "Who wrote Dune?", None, "Frank")], "Who wrote Emma? Not the author of Dune.", set()),
        ([("e1", None, JA, None)], f"前書き。{JA}終わり。", {"e1"}), ([("e1", None, JA, None)], "古い塔の灯台は新しくなった。", set()),
        # scattered: all words in order, with filler after every sixth
        ([("e1", None, PASSAGE, None)], " ".join(w + (" and some other filler words that go on for a very long while" * 12 if n % 6 == 5 else "") for n, w in enumerate(PASSAGE.split())), {"e1"}),
        ([(f"e{i}", f"What did the {w} say of it?", PASSAGE, None) for i, w in enumerate("abbot baker clerk diver envoy friar".split())], f"x {PASSAGE} y", {f"e{i}" for i in range(6)}),
        # damaged beyond its share, but its answer follows
        ([("e1", ASK, None, "Wizo Fogox")], "Who among 26 divers at Port Mupig noticed the notebook of Zujok? Wizo Fogox.", {"e1"}),
    ],
)
def test_leaks_of_unusual_items(spark, items, doc, want):
    it = spark.createDataFrame(items, "item_id string, question string, passage string, ground_truth string")
    docs = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    for per in (20_000, 2):
        assert {r.item_id for r in leakage.find_leaks(docs, it, per_automaton=per).collect()} == want


def test_leaks_without_items(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert leakage.find_leaks(docs, spark.createDataFrame([], "item_id string, question string, passage string")).count() == 0


# 8 -- spam


@pytest.mark.parametrize(
    "page, spam",
    [
        ("cheap loan tool, cheap loan tool, best loan, cheap loan tool, best loan, cheap loan tool", True), ("click here https://a.test/x\nvisit www.b.test/y\nmore info http://c.test/z", True),
        ("#loan #cheaploan #bestdeal #loan_offer #win", True), ("Mug blue 12.99 - add to cart\nCap red 9.99 - in stock\nBag 19.99 - wishlist", True),
        ("No loan tool beats this loan tool when loan tool meets loan tool. Our loan tool, your loan tool, their loan tool: loan tool. Ask about loan tool, read about loan tool, order loan tool.", True),
        ("| model | score |\n|---|---|\n| a | 0.1 |\n| b | 0.2 |\n| c | 0.3 |", False), ("2026-01-01 10:00 judge=a label=1\n2026-01-01 10:01 judge=b label=2", False), ('{"name": "x", "year": 1900, "items": ["a", "b"]}', False),
        ("The mill was closed for years. Nobody knows who owned it. The council asked for a plan and it was sent.\n\nTags: mill, town", False), ("", False), ("12345 12345 12345", False),
        ("Further reading\n1. https://a.example/x. The bootstrap interval for the rate runs from one to two and we kept it as it was.", False),
    ],
)
def test_spam_forms(page, spam):
    assert (pagespam.spam_share(page) > pagespam.SPAM_SHARE) == spam


def test_spam_frame(spark):
    prose = "The mill was closed for years. Nobody knows who owned it. The council asked for a plan and it was sent to the town with a letter. "
    rows = [(i, prose * (1 + i % 3), None) for i in range(20)] + [(50, "cheap loan tool, best loan, " * 20, "xx")] * 2 + [(51, None, "en"), (52, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert [r.doc_id for r in pagespam.spam_pages(df).collect()] == [50]
    assert pagespam.spam_pages(df.limit(0)).count() == 0


def _pages(spark):
    rng = random.Random(2)
    nouns = "mill bridge council letter keeper harbour ledger plan winter tower road market school river archive garden".split()
    say = lambda: f"The {rng.choice(nouns)} was near the {rng.choice(nouns)} and nobody knew who had asked for the {rng.choice(nouns)} in {rng.randrange(1500, 1900)}. "
    rows = [("".join(say() for _ in range(rng.randrange(4, 12)))) for _ in range(60)]
    rows += ["\n".join(f"2026-01-{d:02d} judge=a label={rng.randrange(4)} confidence=0.{rng.randrange(100, 999)}" for d in range(1, 12)) for _ in range(8)]
    rows += [", ".join(f"{rng.choice(['cheap', 'best', 'free'])} loan {rng.choice(['tool', 'app', 'shop'])}" for _ in range(30)) for _ in range(8)]
    # no known form: a stuffed text with function words and full stops
    rows.append("Our loan, your loan, their loan: loan. Loan loan loan now. With loan every loan gets loan and more loan. " * 2)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), {*range(68, 77)}


def test_curves_decide_without_forms(spark):
    df, want = _pages(spark)
    rows = pagespam.scored_pages(df).collect()
    odds = {r.doc_id: r.curve_odds for r in rows}
    assert {r.doc_id for r in pagespam.spam_pages(df, form_weight=0.0).collect()} == want - {76}
    # a stuffed page in no known form is far nearer to spam than any prose or log
    assert {r.doc_id: r.form_share for r in rows}[76] < 0.5 and odds[76] > max(v for k, v in odds.items() if k not in want) + 5


def test_curve_of_a_page_against_numpy(spark):
    text_ = "a a a a b b c https://x.test/y https://z.test 12 13"
    r = pagespam.rank_curves(spark.createDataFrame([(1, text_)], "doc_id long, text string"), "doc_id", "text").first()
    f = np.array([4, 2, 2, 1, 1, 1.0])
    lr, lf = np.log(np.arange(1, 7)), np.log(f)
    fit = np.polyfit(lr, lf, 1)
    assert r.words == 11 and r.distinct == 6 and r.slope == pytest.approx(fit[0]) and r.residual == pytest.approx(np.sqrt(np.mean((lf - np.polyval(fit, lr)) ** 2)))
    assert r.numbers == pytest.approx(2 / 11)


def test_fit_is_held_to_the_prior_without_seeds():
    assert np.allclose(pagespam.fit_seeds(np.zeros((0, len(pagespam.FEATURES))), np.zeros(0)), pagespam.PRIOR)


def test_keys():
    for a, b in itertools.product(("The Élan Mill", "elan-mill", " ELAN  MILL. "), repeat=2):
        assert text.entity_key(a) == text.entity_key(b)
    assert text.entity_key("n/a") is None and text.entity_key("-") is None and text.template_key(" TBD ") is None
    assert text.template_key("In the [entity]?") == text.template_key("in the { ENTITY }")
