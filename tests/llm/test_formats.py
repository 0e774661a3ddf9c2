"""Chat templates and WARC archives."""

import hashlib

import pytest

from trendloom.llm import chat, templates, warc


def text_of(source, context=None, filters=None):
    return "".join(t for t, _ in templates.compile_template(source, filters)(context or {}))


def test_template_language():
    rows = {"rows": [{"a": 1}, {"a": None}]}
    assert text_of("{% for r in rows %}{{ loop.index0 }}{{ r.a }}{% if loop.last %}!{% else %},{% endif %}{% endfor %}", rows) == "01,1!"
    assert text_of("{% if x == 'a' and not y %}1{% elif x %}2{% else %}3{% endif %}", {"x": "b"}) == "2"
    assert text_of("{{ ('a' ~ 1)|up }}", None, {"up": str.upper}) == "A1"
    tree = templates.fold(templates.parse("{{ 'a' ~ 'b' }}c{% if 1 == 2 %}{{ x }}{% endif %}"), {})
    assert tree.parts == (templates.Node("output", (templates.constant("abc"),)),)


@pytest.mark.parametrize("bad", ["{% for x %}{% endfor %}", "{{ a.b( }}", "{% if a %}", "{{ a|nothing }}", "{{ ''.__class__() }}"])
def test_bad_templates(bad):
    with pytest.raises(templates.TemplateError):
        templates.compile_template(bad)


def test_conversations_come_back(spark):
    rows = [(1, 1, "assistant", "b</turn>\\"), (1, 0, "user", None), (1, 0, None, "x: y"), (None, None, "assistant", ""), (2, 5, "assistant", "### é"), (2, 5, "assistant", "### é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.round_trip(chat.with_marker_case(turns)).collect()}
    assert set(got) == {1, 2, None, -7}
    order = "\nx: y\nuser\n\nassistant\nb</turn>\\\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(order.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"b</turn>\\").hexdigest() and got[1]["loss_chars"] == 9
    assert got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 10
    assert got[-7]["loss_sha256"] == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()
    assert chat.round_trip(turns.filter("false")).count() == 0


def test_texts_that_end_like_a_turn(spark):
    long = "x" * 70_000 + "</turn>\n"
    rows = [(1, 0, "user", long, 9), (1, 1, "assistant", "yes</turn>\n", 9), (1, 2, "user", long, 9), (1, 3, "assistant", long, 9)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")
    formatted = chat.format_conversations(turns)
    assert formatted.count() == 3
    got = chat.read_conversations(formatted).collect()[0]
    order = "".join(f"{r[2]}\n{r[3]}\n" for r in rows)
    assert got["n_turns"] == 4 and got["turns_sha256"] == hashlib.sha256(order.encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(f"yes</turn>\n{long}".encode()).hexdigest()


def test_archives_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60
    rows = [(1, "http://a/ b\n", long), (5, None, long), (5, None, long), (None, "u", long), (2, "u", None), (3, "u", ""), (4, "u", "x"), (6, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.resolve_revisits(warc.read_archives(spark, warc.write_archives(pages)), {"payload": warc.F.col("payload")})
    got = sorted((str(r["key"]), r["record_type"], str(r["refers_to"]), bytes(r["payload"])) for r in found.collect())
    body = long.encode()
    want = [("1", "revisit", "5", body), ("5", "response", "None", body), ("5", "response", "None", body), ("None", "revisit", "5", body), ("2", "response", "None", b""), ("3", "response", "None", b""), ("4", "response", "None", b"x"), ("6", "response", "None", b"x")]
    assert got == sorted(want)
    empty = pages.filter("false")
    assert warc.read_archives(spark, warc.write_archives(empty)).count() == 0
