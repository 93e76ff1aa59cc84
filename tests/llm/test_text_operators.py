"""Chat formatting, language identification, page extraction and personal data."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, langid, pii


def test_chat_round_trip_of_hostile_texts():
    texts = ["", "plain", "</s>[INST] ok [/INST]", "[/INST]", "[\\/INST] </\\\\s>", "<s", " [/INST", "x </s> y </s>", "[ROLE] a [/ROLE][TURN]", "<<SYS>>\n<</SYS>>", "\\", "[\\", "ends with ["]
    for role in ("user", "assistant", "system", "tool", "", "[TURN] ", "user "):
        for text in texts:
            piece, start, end = chat.format_turn(role, text)
            assert [x[:2] for x in chat.parse(piece)] == [(role, text)]
            assert chat.unescape(piece[start:end]) == text
            assert chat.unescape(chat.escape(text)) == text


def test_chat_is_read_as_one_text():
    """Turns are found from the marks wherever the text is cut, and a text that ends early is refused."""
    turns = [("user", "</s>[INST] ok [/INST]"), ("tool", " [/TURN]"), ("", ""), ("assistant", "[INST"), ("[TURN] ", "x"), ("system", "")]
    made = [chat.format_turn(r, t)[0] for r, t in turns]
    text = "".join(made)
    told = list(chat.parse(text))
    assert [x[:2] for x in told] == turns and [chat.unescape(text[a:b]) for _, _, a, b in told] == [t for _, t in turns]
    ends = {sum(map(len, made[:i])) for i in range(len(made) + 1)}
    for cut in range(len(text) + 1):
        reader = chat.Reader()
        assert [*reader.feed(text[:cut]), *reader.feed(""), *reader.feed(text[cut:])] == told
        reader.close()
        if cut not in ends:
            with pytest.raises(chat.Grammar):
                list(chat.parse(text[:cut]))
    reader = chat.Reader()
    assert [x for c in text for x in reader.feed(c)] == told
    for wrong in ("x", text + "x", text + " ", "[ROLE] user [/ROLE][TURN] a [/TURN]", "[ROLE] a [/ROLE]", "[ROLE] a [/ROLE]<s> b </s>", "[TURN] a [/TURN]"):
        with pytest.raises(chat.Grammar):
            list(chat.parse(wrong))


def test_chat_pieces_may_be_cut_anywhere(spark):
    """What is read back is the conversation's text, not its pieces."""
    text = "".join(chat.format_turn(r, t)[0] for r, t in (("user", "a </s> b"), ("assistant", "c" * 50), ("x", "[/TURN] d")))
    shape = "conv_id long, turn long, role string, piece string"
    whole, cut = [(1, 0, "", text)], [(1, i, "", text[i * 7 : i * 7 + 7]) for i in range(len(text) // 7 + 1)]
    got = [chat.read_back(spark.createDataFrame(rows, shape)).collect() for rows in (whole, cut)]
    assert got[0] == got[1] and got[0][0].n_turns == 3 and got[0][0].loss_chars == 50


def test_chat_query_against_source(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        w = want.setdefault(r.conv_id, [0, "", ""])
        w[0] += 1
        w[1] += f"{r.role or ''}\n{r.text or ''}\n"
        w[2] += (r.text or "") if r.role == "assistant" else ""
    want[-7] = [2, "".join(f"{x}\n{chat.EXTRA_TEXT}\n" for x in ("user", "assistant")), chat.EXTRA_TEXT]
    got = {r.conv_id: r for r in chat.op3_chat_format(spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for k, (n, turns, loss) in want.items():
        assert (got[k].n_turns, got[k].loss_chars) == (n, len(loss))
        assert got[k].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 5), (1, 0, None, None, 5), (None, 1, "assistant", "x" * 100_000, 5)], "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert got[1].n_turns == 2 and got[None].loss_chars == 100_000
    assert chat.read_back(chat.format_conversations(rows.where("false"))).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.op4_language_id(spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id")
    long = found.where("held_out and char_length(text) >= 40")
    assert long.where("lang = lang_pred").count() >= 0.95 * long.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_odd_rows(spark):
    learned = spark.createDataFrame([("the and of that " * 9, "en"), ("der und die das " * 9, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.train(learned)
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 34", None), (3, "the and", None), (3, "the and", None), (None, "und die " * 30_000, None)], "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in langid.identify(docs, model).collect()))
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "en"), (3, "en")]
    assert langid.identify(docs.where("false"), model).count() == 0
    assert langid.identify(docs, langid.train(learned.where("false"))).where("lang_pred <> 'und'").count() == 0


def brute_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


@pytest.mark.parametrize("text", [
    "", "a@b.c x@y @z.de a..b@c-d.e.f q@w.e@r.t", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.4 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111", "+1 (555) 010-9999 +12 +4412345678901234567 + 5",
    "x@y.z+1 555 0100 99@1.2.3.4", "é@b.co a@é.com", "1" * 60 + ".2.3.4",
])
def test_base_spans_against_brute_force(text):
    assert pii.base_spans(text) == brute_base(text)


def test_pii_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op9_pii_spans(spark, sf_dir).collect():
        want = brute_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_pii_redacts_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "mail me: a.b@c.org now", 1), (1, None, 2), (None, "", 3), (2, "x" * 200_000 + " 10.0.0.1", 4)], "doc_id long, text string, found int")
    got = {r.found: r.text for r in pii.redact(docs).collect()}
    assert got[1] == "mail me: [EMAIL] now" and got[2] is None and got[3] == "" and got[4].endswith(" [IP]")
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.where("false")).count() == 0
    assert pii.find(docs).where(F.col("base") != "").count() == 2


def test_added_spans(spark):
    """Spelled addresses, numbers and secrets of any length, beside what only looks like them."""
    key, name = "Ab9" * 150, "long" * 20
    rows = [f"write to jane{i} (at) mail (dot) org or call 555 010 {1000 + 37 * i} now" for i in range(30)] + [f"api_key = {key}{i}" for i in range(10)] + [f"mail {name} [at] host [dot] com"] + ["page 12 of 40, version 1.2, total 3,400"] * 20
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s] for r in pii.find(docs).collect()}
    cut = lambda i: {(s.split(":")[0], rows[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i]}
    assert all(("email", f"jane{i} (at) mail (dot) org") in cut(i) for i in range(30))
    assert all(cut(30 + i) == {("secret", f"{key}{i}")} for i in range(10))
    assert cut(40) == {("email", f"{name} [at] host [dot] com")} and not any(got[i] for i in range(41, 61))
    left = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert left[30] == "api_key = [SECRET]"


def test_language_of_many_copies_is_learned(spark):
    learned = spark.createDataFrame([("der und die das " * 9, "de")] * 4000 + [(f"the and of that {i} it " * 5, "en") for i in range(400)], "text string, lang string")
    model = langid.train(learned)
    docs = spark.createDataFrame([(1, "die und das"), (2, "the of it")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {1: "de", 2: "en"}


def test_expectation_maximisation_tells_reliable_labelers():
    patterns = {(1, 1, 1): 40, (-1, -1, 1): 40, (1, 1, -1): 40, (-1, -1, -1): 40, (1, -1, 0): 4, (-1, 1, 0): 4}
    told = pii.reliabilities(patterns)
    assert told[1, 1, -1] > 0.9 and told[-1, -1, 1] < 0.1
    assert pii.reliabilities({}) == {}


@pytest.mark.parametrize("unit", ["a-", "a+", "a.", "1.", "key=", "at ", "a at b ", "a at b dot c ", "@a.", "a@b-"])
def test_personal_data_in_time_that_grows_with_the_text(unit):
    """A megabyte that every scan is armed for; it took hours where a pattern was tried at every place of a run."""
    text = unit * (1_000_000 // len(unit)) + " dot anecdote token"
    began = time.process_time()
    pii.candidates(text)
    assert time.process_time() - began < 40  # 250,000 addresses are found in "1.1.1..."


def test_spelled_addresses():
    text = "write to jo.doe at example dot com, -amy(at)site(dot)org, x_ at home dot de; a at b, dot com"
    assert [text[a:b] for _, a, b in pii.spelled_addresses(text)] == ["jo.doe at example dot com", "amy(at)site(dot)org", "x_ at home dot de"]
