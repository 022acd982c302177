import pytest

from fadewatch.llm import surrogates as sg

KEY = b"k"


def kinds(text):
    return [(m.kind, text[m.begin : m.end]) for m in sg.mentions(text)]


def test_what_is_found_and_what_is_not():
    text = 'Write to Jo.Do+1@mail.example.com, call +1 (743) 555-3824 or 743-555-3824. From 8.196.197.208 with token = "1eb9c654e721b4f812088970e66a6345" and 4111 1111 1111 1111.'
    assert kinds(text) == [("email", "Jo.Do+1@mail.example.com"), ("phone", "+1 (743) 555-3824"), ("phone", "743-555-3824"), ("ip", "8.196.197.208"), ("secret", "1eb9c654e721b4f812088970e66a6345"), ("card", "4111 1111 1111 1111")]
    assert kinds("DE89 3704 0044 0532 0130 00 and 123-45-6789") == [("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    assert kinds("Version 2.0. 1.2.3 999.1.1.1 4111111111111112 2024-01-05 12,345 item 77 a@b token = x") == []
    assert kinds("") == [] and kinds("The mister and a doctor") == []


def test_names_keep_gender_script_and_coreference():
    text = "Mrs Anna Smith met Herr Müller. Smith left; MÜLLER stayed. госпожа Иванова, 王小明先生. Smithson is free."
    found = sg.mentions(text)
    assert [(m.kind, text[m.begin : m.end]) for m in found] == [("first-f-latin", "Anna"), ("last-latin", "Smith"), ("last-latin", "Müller"), ("last-latin", "Smith"), ("last-cyrillic", "Иванова"), ("last-cjk", "王小明")]
    new, n = sg.rewritten(text, KEY, {})
    words = new.split()
    assert n == 6 and words[1].endswith("a") and words[2] == words[6] and "Smithson" in new and sg.script_of(words[words.index("госпожа") + 1]) == "cyrillic"
    assert sg.script_of(new[new.index("先生") - 1]) == "cjk" and words[1][0].isupper()


@pytest.mark.parametrize(("text", "secret"), [
    ("password: correcthorsebatterystaple", "correcthorsebatterystaple"),
    ("API_KEY=AbCdEfGhIjKlMnOpQrSt", "AbCdEfGhIjKlMnOpQrSt"),
    ('{"token": "AbCdEfGhIjKlMnOpQrSt"}', "AbCdEfGhIjKlMnOpQrSt"),
    (r'{\"accessToken\": \"AbCdEfGhIjKlMnOpQrSt\"}', "AbCdEfGhIjKlMnOpQrSt"),
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ("secret_key: 'AbCdEfGhIjKlMnOpQrSt'", "AbCdEfGhIjKlMnOpQrSt"),
    ("x-api-key: AbCdEfGhIjKlMnOpQrSt", "AbCdEfGhIjKlMnOpQrSt"),
])
def test_secrets_of_letters_and_in_longer_names(text, secret):
    assert kinds(text) == [("secret", secret)]
    new, n = sg.rewritten(text, KEY, {})
    assert n == 1 and secret not in new and [k for k, _ in kinds(new)] == ["secret"]


def test_no_secret_in_longer_words_or_rules():
    assert kinds("tokenizer: AbCdEfGhIjKlMnOpQrSt, secretary: AbCdEfGhIjKlMnOpQrSt, Password\n====================\n") == []


def test_the_hint_loses_nothing(monkeypatch):
    pieces = ["password: correcthorsebatterystaple", "TOKEN='AbCdEfGhIjKlMnOpQrSt'", "call ٧٤٣-٥٥٥-٣٨٢٤", "from ८.१९६.१९७.२०८", "a.b@x.org", "Mrs Anna Smith", "王小明先生", "4111 1111 1111 1111", "no data", ""]
    found = [sg.mentions(t) for t in pieces]
    monkeypatch.setattr(sg, "HINT", sg.regex.compile(""))
    assert found == [sg.mentions(t) for t in pieces]
    assert [len(x) for x in found] == [1, 1, 1, 1, 1, 2, 1, 1, 0, 0]


@pytest.mark.parametrize(("surface", "kind"), [("+1 (743) 555-3824", "phone"), ("4111-1111-1111-1111", "card"), ("10.1.2.3", "ip"), ("DE89370400440532013000", "iban"), ("A.B9@X.org", "email")])
def test_surrogates_keep_their_format(surface, kind):
    new, n = sg.rewritten(f"x {surface} y", KEY, {})
    new = new[2:-2]
    assert n == 1 and new != surface and kinds(f"x {new} y") == [(kind, new)]
    if kind not in ("email", "ip"):
        assert [c.isalnum() for c in new] == [c.isalnum() for c in surface]
    if kind == "ip":
        assert new.startswith("10.")
    assert sg.rewritten(f"x {surface} y", b"other", {})[0][2:-2] != new


def test_clashes_are_resolved(spark):
    def crowded(key, kind, canon, attempt):
        return str((int(canon) * 7 + attempt * 3) % (40 + 30 * attempt) + 1000 - (950 if canon == "60" and attempt == 0 else 0))

    entities = spark.createDataFrame([("n", str(k)) for k in range(100)] + [("m", "5")], "kind string, canon string")
    rows = sg.assign(entities, KEY, crowded).collect()
    assert len(rows) == 101 and len({(r.kind, r.new) for r in rows}) == 101
    assert not {(r.kind, r.new) for r in rows} & {(r.kind, r.canon) for r in rows}
    assert max(r.attempt for r in rows) > 0


def test_moved_entities_are_rewritten_by_their_attempt(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call 743-555-3824 now", "a"), (2, "call 743-555-3824 now", None), (3, None, "b"), (4, "nothing here", "c"), (None, "", None)], "doc_id long, text string, n_entities string")
    taken = sg.rewritten("743-555-3824", KEY, {})[0]
    more = docs.union(spark.createDataFrame([(5, f"and {taken}", "d")], docs.schema))
    rows = {r.doc_id: (r.text, r.n_entities) for r in sg.replace(more, KEY).collect()}
    assert rows[1] == rows[2] and rows[1][0] != f"call {taken} now" and rows[1][1] == 1
    assert rows[3] == (None, 0) and rows[4] == ("nothing here", 0) and rows[None] == ("", 0)
    assert sg.replace(docs.limit(0), KEY).count() == 0


def test_corpus_has_distinct_consistent_surrogates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: (r.text, r.n_entities) for r in sg.replace(docs, KEY).collect()}
    pairs = set()
    for d, text in before.items():
        old, new = sg.mentions(text), sg.mentions(after[d][0])
        assert (not old) == (after[d][0] == text) and len(old) == after[d][1]
        assert [m.kind for m in old] == [m.kind for m in new]
        pairs |= {(m.kind, m.canon, w.canon) for m, w in zip(old, new, strict=True)}
    assert len(pairs) > 20 and len(pairs) == len({p[:2] for p in pairs}) == len({(p[0], p[2]) for p in pairs})
