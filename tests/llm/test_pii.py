import random
import re

import numpy as np

from marlstone.llm import pii
from marlstone.llm.pii import LABELLED, Decoder, Field, features, find_pii, joined_spans, mask_pii, parsed, pattern_spans, spans_of, trained


def brute(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def test_patterns_equal_plain_expressions():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choices("ab0123456789.@+-() é%\n", weights=[2, 2, *[1.5] * 10, 4, 3, 2, 1, 1, 1, 3, 1, 1, 1], k=r.randint(0, 60)))
        assert sorted(pattern_spans(t)) == sorted(brute(t)), t


def test_field_finds_held_out_cases_and_leaves_prose():
    found = lambda t: [(t[a:b], k) for a, _, b, k in sum(spans_of([t], Decoder(trained()))[0], [])]
    assert found("and Dr. Maria Keller , hello") == [("Maria Keller", "name")]
    assert found("Dear Mrs. Eva Lang, welcome back") == [("Eva Lang", "name")]
    assert found("her SSN is 321-54-9876.") == [("321-54-9876", "number")]
    assert found("IBAN GB29NWBK60161331926819 please") == [("GB29NWBK60161331926819", "number")]
    for t in ("Thant eringing onheed, with. Erenenst thaner ing tionha and.", "In 2004 we sold 45 flats.", "Über das Haus. Ein Satz, ein Wort."):
        assert found(t) == []


def test_viterbi_equals_exhaustive_search():
    field, r = trained(), random.Random(3)
    vocab = [w for words, _ in parsed(LABELLED) for w in words if w[-1] not in ".!?"]
    for _ in range(40):
        words = r.choices(vocab, k=r.randint(1, 6))
        got = Decoder(field).labels([[w.encode() for w in words]], [np.array([len(words) - 1])])[0][0]
        rows, edge = [field.table_row(features(w)) for w in words], field.weights[:, -1]

        def value(path):
            total = 0.0
            for t, y in enumerate(path):
                total += field.bias[y] + rows[t][1][y]
                total += rows[t - 1][0][y] if t else edge[0][y]
                total += rows[t + 1][2][y] if t + 1 < len(path) else edge[2][y]
                total += field.steps[path[t - 1], y] if t else 0
            return total

        import itertools

        best = max(itertools.product(range(3), repeat=len(words)), key=value)
        assert abs(value(best) - value(tuple(got))) < 1e-9
    assert "s=X" in features("USA") and isinstance(field, Field)


def test_long_chains_are_decoded_whole(monkeypatch):
    field, r = trained(), random.Random(4)
    score = np.random.default_rng(5).normal(size=(3000, 3))
    stops, at = [], 0
    while at < 3000:
        at = min(3000, at + r.choice([1, 2, 5, 63, 64, 65, 130, 700]))
        stops.append(at)
    cut = Decoder(field)._viterbi(score, np.array(stops))
    monkeypatch.setattr(pii, "PIECE", 10_000)
    assert (Decoder(field)._viterbi(score, np.array(stops)) == cut).all()
    monkeypatch.setattr(pii, "PIECE", 7)
    assert (Decoder(field)._viterbi(score, np.array(stops)) == cut).all()


def test_no_run_or_word_is_too_long():
    found = lambda t: [(t[a:b], k) for a, _, b, k in sum(spans_of([t], Decoder(trained()))[0], [])]
    assert found("wrote to Mrs. Anna Maria Clara Eva Schmidt , who") == [("Anna Maria Clara Eva Schmidt", "name")]
    prose = " ".join(["and the house is there"] * 400)
    assert found(f"{prose} her SSN is 321-54-9876 {prose}") == [("321-54-9876", "number")]
    assert pii.shape("a" * 5000 + "1" * 3 + "-" + "2" * 90) == "xddd-d+" and pii.shape("x" * 300 + "-" + "Y" * 300) == "x-X"


def test_rows(spark):
    texts = [None, "", "mail a.b@c.example.com now", "x " * 40000 + "10.0.0.1", "mail a.b@c.example.com now"]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in enumerate(texts)] + [(None, "ssn 078-05-1120 was", 5, "k")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in find_pii(df).collect()}
    assert got[0].spans == got[1].spans == "" and got[2].n_email == 1 and got[2].spans == "email:5:22" == got[4].spans
    assert got[3].spans == "ip:80000:80008" and got[None].spans == "number:4:15"
    assert joined_spans([(5, 1, 6, "b"), (5, 0, 9, "a")]) == "a:5:9,b:5:6"
    out = {r.doc_id: r for r in mask_pii(df).collect()}
    assert out[2].text == "mail [EMAIL] now" and out[2].n_chars == 16 and out[0].text is None and out[0].n_chars == 5
    twice = spark.createDataFrame([(1, "a@b.com")] * 2 + [(1, None)], "doc_id long, text string")
    assert sorted(r.n_email for r in find_pii(twice).collect()) == [0, 1, 1]
    assert mask_pii(df).columns == df.columns and find_pii(df.limit(0)).count() == 0
