from __future__ import annotations

import hashlib
import re
import time
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataframe.llm import pii as op


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """The contract's patterns, tried as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


bits = st.lists(st.sampled_from(["a", "b@", "@", ".", "-", "1", "255", "4111", " ", "+4", "(", ")", "_", "é", "\n", "0", "12.3.4.5", "x@y.z", "4111 1111 1111 1111", "+1 555 123 4567", "at", "dot", "one", "two"]), max_size=24).map("".join)


@settings(max_examples=400, deadline=None)
@given(bits)
def test_base_spans_equal_the_patterns(text):
    base, _ = op.find(text)
    assert sorted(base) == sorted(plain(text))


@pytest.mark.parametrize(
    "text,kind,shown",
    [
        ("write to jane [at] mail (dot) org now", "email", "jane [at] mail (dot) org"),
        ("write to jane.roe at mail dot com now", "email", "jane.roe at mail dot com"),
        ("mail jаne@mаil.org", "email", "jаne@mаil.org"),  # Cyrillic a
        ("call plus four nine three zero one two three four five six seven today", "phone", "plus four nine three zero one two three four five six seven"),
        ("card four one one one 1111 1111 one one one one end", "card", "four one one one 1111 1111 one one one one"),
        ("ip １９２.168.0.1 here", "ip", "１９２.168.0.1"),
        ("ip 10 dot 0 dot 0 dot 1 here", "ip", "10 dot 0 dot 0 dot 1"),
        ("me＠site．org", "email", "me＠site．org"),
        ("jane dot roe at mail dot example dot com.", "email", "jane dot roe at mail dot example dot com"),
        ("jane_at_mail_dot_org it is", "email", "jane_at_mail_dot_org"),
        ("jane @ mail . org it is", "email", "jane @ mail . org"),
        ("server one nine two dot one six eight dot zero dot one is up", "ip", "one nine two dot one six eight dot zero dot one"),
        ("ruf plus vier neun drei null eins zwei drei vier fünf sechs an", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs"),
        ("call +1 5O5 l23 4567 now", "phone", "+1 5O5 l23 4567"),
        ("card 4lll 1111 1111 1111 ok", "card", "4lll 1111 1111 1111"),
        ("𝐣𝐚𝐧𝐞@𝐦𝐚𝐢𝐥.𝐨𝐫𝐠", "email", "𝐣𝐚𝐧𝐞@𝐦𝐚𝐢𝐥.𝐨𝐫𝐠"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, shown):
    base, added = op.find(text)
    assert (kind, text.index(shown), text.index(shown) + len(shown)) in base + added


@pytest.mark.parametrize(
    "text,kind,shown,short",
    [
        ("mail jаne@mail.org now", "email", "jаne@mail.org", "ne@mail.org"),  # Cyrillic a
        ("mail jane@mail.cоm now", "email", "jane@mail.cоm", "jane@mail.c"),  # Cyrillic o
        ("mail jane dot roe@mail.com now", "email", "jane dot roe@mail.com", "roe@mail.com"),
        ("call +1 555 123 456７ now", "phone", "+1 555 123 456７", "+1 555 123 456"),
    ],
)
def test_longer_spans_stay_beside_the_plain_ones(text, kind, shown, short):
    span = lambda x: (kind, text.index(x), text.index(x) + len(x))
    assert op.find(text) == ([span(short)], [span(shown)])
    assert op.redacted(text) == text.replace(shown, f"[{kind.upper()}]")


@pytest.mark.parametrize("far", ["", "\u00a0", " – ", " １", " it costs 5 . "])
@pytest.mark.parametrize(
    "text,shown",
    [
        ("write to jane.roe at mail.com", "jane.roe at mail.com"),
        ("write to jane at mail.com", "jane at mail.com"),
        ("ask jane77 at mail.shop", "jane77 at mail.shop"),
        ("jane at mail dot shop", "jane at mail dot shop"),
        ("ask jane at mail dot example dot xyz", "jane at mail dot example dot xyz"),
        ("look at example.com", None),
        ("contact us at example.com", None),
        ("stare at one dot and wait", None),
    ],
)
def test_a_bare_at_is_judged_by_its_passage(text, shown, far):
    text += f" now. Other words{far}follow."
    assert op.find(text) == ([], [("email", text.index(shown), text.index(shown) + len(shown))] if shown else [])


@pytest.mark.parametrize("far", ["", " and 5o more"])
@pytest.mark.parametrize(
    "kind,shown",
    [
        ("phone", "+1 555 OOO 4567"),
        ("card", "4111 llll 1111 1111"),
        ("ip", "1O.0.0.1"),
        ("ip", "l92.l68.O.l"),
        ("card", "4OOO OOOO OOOO OOO2"),
        ("phone", "plus 4 nine 3 zero 1 two 3 four 5 six"),
        ("phone", "+4 nine 3 zero 1 two 3 four 5 six"),
        ("phone", "+4 nine 3 0 1 2 3 4 5 6"),
        ("phone", "+1 555 123 4567 I said so"),
    ],
)
def test_numbers_are_judged_by_themselves(kind, shown, far):
    text = f"it is {shown} now{far}"
    shown = shown.removesuffix(" I said so")
    base, added = op.find(text)
    assert base + added == [(kind, 6, 6 + len(shown))]


@pytest.mark.parametrize("text", ["We met at noon dot by dot.", "one two three", "after the dot com boom", "one two three four", "un dos tres", "cat-at-arms and state_at_rest", "1 . 2 . 3", "версия 1.2.3", "x at y", "one, two, three, four and five"])
def test_clean_texts_have_no_spans(text):
    assert op.find(text) == ([], [])


def test_long_runs_stay_linear():
    mb = 1 << 20
    for text in ("a dot " * (mb // 6), "1 dot " * (mb // 6), "x at " + "a dot " * (mb // 6), "a at b " * (mb // 7), "a@b.com " * (mb // 8) + " j at x dot com", "one two three " * (mb // 14), "l l l 1 " * (mb // 8), "a_at_b_dot_c " * (mb // 13), "( at ) " * (mb // 7), "аео " * (mb // 7), "a" * mb + " at example.com", "a-" * (mb // 2) + " at example.com", "-" * mb + " at example.com", "5 " + "O " * (mb // 2) + "5", "5 " + "O " * (mb // 2), "O " * (mb // 2) + "5"):
        began = time.process_time()
        op.find(text)
        assert time.process_time() - began < 8
    for text in ("a" * 200_000, "1" * 200_000, "a." * 100_000, "1 " * 100_000, "@" * 100_000, "+1" * 100_000, "a@" * 100_000):
        op.find(text)


def test_a_long_text_with_one_disguise_costs_little_more_than_itself():
    text = "plain words and more of them here. " * (8 << 20 >> 5)
    text = f"{text[:999]}\u00a0{text[999:]} jane at mail dot shop"
    tracemalloc.start()
    try:
        base, added = op.find(text)
        assert not base and [text[a:b] for _, a, b in added] == ["jane at mail dot shop"]
        assert tracemalloc.get_traced_memory()[1] < 12 * len(text)
    finally:
        tracemalloc.stop()


def test_spans_through_several_edits():
    text = "x\u200by \u00ad jаne dot r\u200boe at mail dot com, plus four nine three zero one two three four five six and then 1 dot 2 dot 3 dot 4 end"
    assert [text[a:b] for _, a, b in op.find(text)[1]] == ["jаne dot r\u200boe at mail dot com", "1 dot 2 dot 3 dot 4", "plus four nine three zero one two three four five six"]


def test_query_digests(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op.op6_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        spans = sorted(plain(docs[r["doc_id"]]), key=lambda s: (op.KINDS.index(s[0]), s[1]))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in op.KINDS] == [sum(s[0] == k for s in spans) for k in op.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(","))


def test_odd_rows(spark, odd_documents, no_documents):
    got = op.find_pii(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert [r["n_email"] for r in got if r["doc_id"] is None] == [1]
    assert op.find_pii(no_documents).count() == 0
    kept = op.redact(odd_documents)
    assert kept.schema == odd_documents.schema
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[None] == "no id here at all, mail me at [EMAIL]" and texts[2] is None and texts[3] == ""


@pytest.mark.parametrize("part", ["5 5 O I", "5 O", "5 (O", "5.- O ) I", "5O", " O", "5", "", "O I l", "5 O I5", "5  O", "5 -I"])
def test_single_letters_at_the_end_as_a_pattern_finds_them(part):
    found = re.search(r"(?:[ ().-]* [OolI])+$", part)
    assert op._before_lone_letters(part) == (found.start() if found else len(part))


@pytest.mark.parametrize("local", ["ab-c1", "-a1", "a-", "--", "1a", "1-a", "ab", "a b1", "x-9", "-9", "9-", "a--9", "a.b"])
def test_signs_of_a_local_part_are_those_of_the_plain_pattern(local):
    plain = re.compile(r"[A-Za-z0-9](?:[._%+]| dot )[A-Za-z0-9]|[A-Za-z][A-Za-z-]*[0-9]|[0-9]-?[A-Za-z]", re.I)
    assert bool(op._LOCAL_SIGN.search(local)) == bool(plain.search(local))
