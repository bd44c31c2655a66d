from graphloom.llm import op04_pii as O
from tests.llm.common import awkward, docs_of


def kinds(text):
    return [(k, text[a:b]) for a, b, k, _ in O.spans(text)]


def test_validators():
    assert O.luhn("4111111111111111") and not O.luhn("4111111111111112")
    assert O.mod97("GB82WEST12345698765432") and not O.mod97("GB83WEST12345698765432")
    for number in ("4012888888881881", "5555555555554444"):
        wrong = [number[:-1] + d for d in "0123456789" if O.luhn(number[:-1] + d)]
        assert wrong == [number]


def test_spans():
    assert kinds("write to jo.doe@mail.example.org now") == [("EMAIL", "jo.doe@mail.example.org")]
    assert kinds("card 4111 1111 1111 1111.") == [("CARD", "4111 1111 1111 1111")]
    assert kinds("card 4111 1111 1111 1112") == []
    assert kinds("iban GB82 WEST 1234 5698 7654 32 please") == [("IBAN", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("iban GB83 WEST 1234 5698 7654 32 please") == []
    assert kinds("host 192.168.10.7") == [("IPV4", "192.168.10.7")] and kinds("host 392.168.10.7") == []
    assert kinds("ssn 123-45-6789") == [("SSN", "123-45-6789")] and kinds("ssn 000-45-6789") == []


def test_cards_beside_other_numbers():
    card = "4111 1111 1111 1111"
    for text in (f"card {card} 12/27", f"card {card} 123", f"card 43 {card}", f"visa 7 {card} 9 8", f"card {card} {card[:14]} 12"):
        assert ("CARD", card) in kinds(text), text
    assert ("CARD", "4111-1111-1111-1111") in kinds("2024 4111-1111-1111-1111")
    assert [k for k, _ in kinds("cards 4111 1111 1111 1111 5555 5555 5555 4444")] == ["CARD"] * 2
    assert O.redacted(f"card 42 {card}") == "card [CARD]"  # the number before it happens to pass too: the longer stretch goes
    assert kinds("card " + "4111111111111111" * 2) == []


def test_many_numbers_are_settled_quickly():
    got = O.spans("1 2 3 4 5 6 7 8 9 0 " * 20000)
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_stretches_equal_a_loop():
    run = "7 41 5555-1 444 12 0 3 9 88 4111 1111 1111 1111 123 6 2 5 8"
    groups = list(O.GROUP.finditer(run))
    want = [(a.start(), b.end()) for k, a in enumerate(groups) for b in groups[k:] if 13 <= len(d := O._ascii_digits(run[a.start() : b.end()])) <= 19 and O.luhn(d)]
    assert list(O.cards(run)) == want and (run.index("4111"), run.index(" 123")) in want


def test_secrets_to_their_end():
    value = "aB3dE5gH7jK9" * 100
    assert kinds(f"token = {value} end") == [("SECRET", value)] and kinds(f"key sk-{value}.") == [("SECRET", f"sk-{value}")]
    assert O.redacted(f"token = {value} end") == "token = [SECRET] end"


def test_secrets_without_digits():
    word = "CorrectHorseBatteryStaple"
    assert kinds(f"password = {word} and so on") == [("SECRET", word)] and O.redacted(f"the Password: '{word}'") == "the Password: '[SECRET]'"
    assert kinds("ghp_" + "abcdefghijklmnopqr" * 2) == [("SECRET", "ghp_" + "abcdefghijklmnopqr" * 2)]
    assert kinds("a secret: wohnungseigentumsverwaltung") == [] and kinds("no key here, only words") == []


def test_long_mail_addresses():
    name = "a.b-c" * 40
    host = ".".join(f"part{k}" for k in range(20)) + ".example.technology"
    assert kinds(f"mail ({name}@{host})") == [("EMAIL", f"{name}@{host}")]
    assert kinds("a@b.org@c.org") == [("EMAIL", "a@b.org")] and kinds("@a.org x@@b.org") == []
    assert len(kinds("x" * 200000 + " " + "y@z.org " * 20000)) == 20000


def brute_emails(text):
    """Every stretch of the text, by the rules alone."""
    import re

    whole = re.compile(r"[A-Za-z0-9_%+-](?:[A-Za-z0-9_%+-]|\.(?!\.))*(?<!\.)@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63}")
    found = {(a, b) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if whole.fullmatch(text[a:b])}
    return [(a, b) for a, b in sorted(found) if not any((c, d) != (a, b) and c <= a and b <= d for c, d in found)]


def test_mail_addresses_equal_every_stretch():
    for text in ("write to j.doe@mail.example.org, or x+y@a-b.co", "no at sign", "a@b, c@d.e, f@gh.ij.", "(me@x.org)(you@y.org)"):
        assert [(a, b) for a, b, k, _ in O.spans(text) if k == "EMAIL"] == brute_emails(text), text


def test_context_moves_the_score():
    assert kinds("call 555 123 4567") == [("PHONE", "555 123 4567")]
    assert kinds("we sold 555 123 4567") == [] and kinds("order 555 123 4567") == []
    plain, near = O.spans("x 4111111111111111")[0][3], O.spans("card 4111111111111111")[0][3]
    assert near > plain


def test_overlaps_leave_one():
    got = O.spans("tel +49 4111 1111 1111 1111")
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_frames(spark):
    docs = docs_of(spark, ["mail a@b.org and c@d.org", "clean text", "card 4111111111111111"], extra=["kind", "start"])
    assert sorted((r["doc_id"], r["kind"], r["start"], r["end"]) for r in O.find_pii(docs).collect()) == [(0, "EMAIL", 5, 12), (0, "EMAIL", 17, 24), (2, "CARD", 5, 21)]
    out = O.redact_pii(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()} == {0: ("mail [EMAIL] and [EMAIL]", 24), 1: ("clean text", 10), 2: ("card [CARD]", 11)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    out = O.redact_pii(docs)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert O.find_pii(docs).count() == 0 and O.find_pii(docs.where("false")).count() == 0 and O.redact_pii(docs.where("false")).count() == 0
    many = "mail " + " ".join(f"u{k}@x{k}.org" for k in range(5000))
    assert O.find_pii(docs_of(spark, [many, many])).count() == 10000
