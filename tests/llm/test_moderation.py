import random

import numpy as np

from annalist.llm import moderation as m


def test_disguises_are_undone():
    plain = m.sentence_words("you stink you idiot")
    for s in ("You st1nk you 1d10t", "you s t i n k you i.d.i.o.t", "YOU STIIINK YOU IDIOOOT", "yоu stink you idi​ot"):
        assert m.sentence_words(s) == plain, s


def test_sentences():
    assert m.split_sentences("One. Two?\nThree\tfour  five") == ["One.", "Two?", "Three", "four", "five"]
    assert m.split_sentences(None) == m.split_sentences("") == m.split_sentences(" \n ") == []


def docs(n=900, seed=1):
    rng = random.Random(seed)
    calm = ["the scribe copies the verse", "the printer joins the list", "a goat was sold at the market", "thank you for the scan", "this reading is simply wrong"]
    rude = ["you are a worthless goat", "shut your filthy mouth you goat", "nobody would miss you"]
    out, labels = [], []
    for i in range(n):
        s = [rng.choice(calm) for _ in range(rng.randint(1, 6))]
        bad = rng.random() < 0.15
        if bad:
            s.insert(rng.randint(0, len(s)), rng.choice(rude))
        out.append((i, ". ".join(s), "src" if i % 2 else None))
        y = int(bad) if rng.random() > 0.02 else 1 - int(bad)
        labels.append((i, y, 0, None if i % 7 == 0 else y, bad))
    return out, labels


def test_held_out(spark):
    out, labels = docs()
    truth = {i: bad for i, *_, bad in labels}
    extra = [(9001, None, "src"), (9002, "", "src"), (9003, "   ", None), (9004, "the scribe copies the verse. " * 3000 + "you are a worthless goat", "src")]
    df = spark.createDataFrame(out + extra, "doc_id bigint, text string, source string").repartition(3)
    lab = spark.createDataFrame([x[:4] for x in labels if x[0] < 600], "doc_id bigint, abusive int, hateful int, sexual int")
    model, report = m.train(df, lab)
    assert [r[0] for r in report] == list(m.CATEGORIES) and report[0][1] == 600
    hits, false, missed, sure_hits, sure_false, sure_missed = report[0][5:]
    assert hits >= sure_hits > 50 and missed >= sure_missed and false >= sure_false and false + missed < 30
    got = {r.doc_id: r for r in m.score_documents(df, model, ["doc_id", "source"]).collect()}
    assert len(got) == len(out) + 4
    test = [i for i in truth if i >= 600]
    assert np.mean([got[i].flag_abusive == truth[i] for i in test]) > 0.97
    assert not any(r.flag_hateful for r in got.values())
    assert got[9001].score_abusive == got[9002].score_abusive == got[9003].score_abusive == 0
    assert got[9004].flag_abusive and "goat" in got[9004].sentence_abusive
    assert all(("you" in r.sentence_abusive) for r in got.values() if r.flag_abusive and r.doc_id < 9000)
    rates = m.source_rates(m.score_documents(df, model, ["doc_id", "source"])).collect()
    assert {r.source for r in rates} == {"src", None} and sum(r.documents for r in rates) == len(out) + 4


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "you idiot", None)], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, abusive int, hateful int, sexual int")
    model, _ = m.train(df, none)
    r = m.score_documents(df, model, ["doc_id"]).collect()[0]
    assert not (r.flag_abusive or r.flag_hateful or r.flag_sexual)
    assert m.score_documents(df.limit(0), model, ["doc_id"]).collect() == []


def test_bound_of_features(spark):
    """The fit takes whole documents in the order of a hash until their features fill the bound; all are scored."""
    out, labels = docs(300)
    df = spark.createDataFrame(out, "doc_id bigint, text string, source string").repartition(3)
    lab = spark.createDataFrame([x[:4] for x in labels], "doc_id bigint, abusive int, hateful int, sexual int")
    whole, _ = m._labelled(df, lab, "doc_id", "text", 1000, 10**9)
    part, y = m._labelled(df, lab, "doc_id", "text", 1000, len(whole.features) // 2)
    assert len(whole) == 300 and 100 < len(part) < 200 and len(y) == len(part) and len(part.features) <= len(whole.features) // 2
    assert np.array_equal(part.features, whole.features[: len(part.features)])


def test_bags_are_made_sentence_by_sentence():
    one, bags = m.make_bags(["You fool. Go away now", None, "x"])
    assert [len(s) for s in one] == [2, 0, 1] and len(bags) == 3
    alone = [m.make_bags([s])[1].features for s in ("You fool.", "Go away now", "x")]
    assert np.array_equal(bags.features, np.concatenate(alone))
