import hashlib
import random

from helpers import docs, prose

from stallwright.llm import pii as P


def test_base_spans_equal_the_patterns():
    r = random.Random(3)
    for alphabet in ("ab.@+-19 4()%Z\n", "0123456789 -+.", "a@b.c1"):
        for _ in range(5000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 50)))
            assert hashlib.sha256(P.joined(P.spans(t)[0]).encode()).hexdigest() == P.brute_force(t), t


def found(text):
    return [(k, text[a:b]) for a, k, b in P.spans(text)[1]]


def test_disguises_map_back_to_the_source():
    assert found("mail bob (at) site [dot] com now") == [("email", "bob (at) site [dot] com")]
    assert found("write bob at example dot com") == [("email", "bob at example dot com")]
    assert found("call plus one five five five one two three four five six seven!") == [("phone", "plus one five five five one two three four five six seven")]
    assert found("аlice@exаmple.com") == [("email", "аlice@exаmple.com")]
    assert found("１９２.168.0.1 x") == [("ip", "１９２.168.0.1")]
    assert found("we met at the gate. Four or five came") == []


def test_operator(spark):
    texts = {1: "a@b.co and 10.0.0.1", 2: None, 3: "", 4: "+1 555 123 4567, 4111-1111-1111-1111", 5: "x" * 200_000 + " 1" * 50_000, 6: prose(1, 50)}
    df = docs(spark, texts, {"masked": "m", "n_ip": 9})
    rows = {r.doc_id: r for r in P.personal_data(df.unionByName(df.where("doc_id = 1"))).collect()}
    assert (rows[1].n_email, rows[1].n_ip, rows[1].spans) == (1, 1, "email:0:6,ip:11:19")
    assert rows[1].masked == "<EMAIL> and <IP>" and rows[4].masked == "<PHONE>, <CARD>" and rows[6].masked == texts[6]
    assert rows[2].spans == rows[3].spans == ""
    clean = P.without_personal_data(df)
    assert clean.columns == df.columns
    assert {r.doc_id: r.n_chars for r in clean.collect()}[1] == len("<EMAIL> and <IP>")
    assert P.personal_data(df.limit(0)).count() == 0


def test_invisible_characters_alone_disguise():
    for c in P.INVISIBLE:
        for t, k in ((f"bob@exam{c}ple.com", "email"), (f"bob{c}@example.com", "email"), (f"4111{c}-1111-1111-1111", "card")):
            assert (k, t) in found(f"x {t} y") and P.masked(f"x {t} y") == f"x <{k.upper()}> y", (t, found(t))


def test_longer_disguised_spans_are_added_beside_base_spans():
    for t, mask in (("jоhn@example.com", "<EMAIL>"), ("john [dot] smith@example.com", "<EMAIL>"), ("+1 555 123 456 seven eight", "<PHONE>")):
        base, whole = P.spans(t)
        assert len(base) == 1 and len(whole) == 2 and set(base) < set(whole) and P.masked(t) == mask
    assert P.spans("а bob@example.com")[0] == P.spans("а bob@example.com")[1]


def test_worded_forms_and_digits_of_all_scripts():
    for t in ("john@example dot com", "john at example.com", "a.b.c.d.e.f at x dot com", "a dot b dot c dot d dot e dot f at x dot com", "x at g dot b dot c dot d dot e dot f dot com"):
        assert found(f"so, {t}, then") == [("email", t)], (t, found(f"so, {t}, then"))
    assert P.masked("so a dot b@c.org, then") == "so <EMAIL>, then"
    assert found("so 192 dot 168 dot 0 dot 1, then") == [("ip", "192 dot 168 dot 0 dot 1")]
    for zero in (0x660, 0x9E6, 0xE50, 0x1040, 0x1D7CE):  # Arabic, Bengali, Thai, Myanmar, mathematical bold
        t = "".join(chr(zero + int(c)) if c.isdigit() else c for c in "192.168.0.1")
        assert found(f"so {t} then") == [("ip", t)]
    assert found("we met at the gate, at 10.30 and at noon") == []


def test_worded_forms_take_linear_time():
    P.spans("a dot " * 40_000 + "b at c " * 40_000 + "a@b dot c " * 20_000)


def test_compatibility_forms_and_plus():
    bold = lambda t: "".join(chr(0x1D41A + ord(c) - 97) if c.isalpha() else c for c in t)
    for t, kind in ((bold("bob") + "@" + bold("example") + ".com", "email"), ("bob\uff20example\u2024com", "email"), ("4111\u20131111\u20131111\u20131111", "card"), ("4111\u00a01111\u00a01111\u00a01111", "card"), ("plus 1 555 123 4567", "phone")):
        assert found(f"so {t} then") == [(kind, t)], t
        assert P.masked(f"so {t} then") == f"so <{kind.upper()}> then"
    for c, plain in P.CHARACTERS.items():
        assert plain.isascii() and not c.isascii()


def test_added_spans_equal_a_brute_force_over_characters():
    """Texts whose only disguise is characters: read one by one into plain text, searched there and mapped back."""
    r = random.Random(11)
    odd = sorted(c for c, plain in P.CHARACTERS.items() if len(plain) < 3)
    for _ in range(1500):
        t = "".join(r.choice([*"ab1290.@-+ ", r.choice(odd)]) for _ in range(r.randint(0, 40)))
        plain, source = "", []
        for i, c in enumerate(t):
            for x in P.CHARACTERS.get(c, c):
                plain += x
                source.append(i)
        if any(w in plain.lower() for w in ("at", "dot")) or any(b in plain for b in "[({<"):
            continue
        base = P.identifiers(t)
        want = {(a, k, b) for k, spans in base.items() for a, b in spans}
        for k, spans in P.identifiers(plain).items():
            for a, b in spans:
                first, end = source[a], source[b - 1] + 1
                if t[first:end] != plain[a:b] and not any(x <= first and end <= y for x, y in base[k]):
                    want.add((first, k, end))
        assert set(P.spans(t)[1]) == want, t


def test_query(spark, tmp_path):
    from stallwright.llm.queries import QUERIES

    texts = {1: "a@b.co and 10.0.0.1", 2: None, 3: "", 4: "\u0430 \u2022 bob (at) site [dot] com", 5: "x" * 100_000 + " 4111-1111-1111-1111"}
    docs(spark, texts, {"spans": 1}).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in QUERIES["op7_pii"](spark, str(tmp_path)).collect()}
    for k, t in texts.items():
        assert rows[k].base_sha256 == P.brute_force(t) and rows[k].spans == P.joined(P.spans(t)[1])
    assert rows[4].n_email == 0 and rows[4].spans.startswith("email:4:")
