import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from lever.llm import op05_chat as op05
from lever.llm.template import Compiler, TemplateError, parse
from tests.llm.helpers import rng, words

TURNS = "conv_id bigint, turn bigint, role string, text string, piece int, loss string"


def render(source, **env):
    return "".join(t for t, _ in Compiler().template(source)(env))


@pytest.mark.parametrize("source, env, want", [
    ("a{{ 'b' + 1 }}c", {}, "ab1c"),
    ("{% for x in xs %}{{ loop.index0 }}{{ x.n|upper }}{% if not loop.last %}, {% endif %}{% endfor %}",
     {"xs": [{"n": "a"}, {"n": "b"}]}, "0A, 1B"),
    ("{% if x == 1 and y != 'q' %}1{% elif x == 2 or false %}2{% else %}3{% endif %}", {"x": 2, "y": ""}, "2"),
    ("{{ a['k'] }}{{ (a.k + \"\\n\")|trim }}{{ none }}{{ a.missing }}", {"a": {"k": "v"}}, "vv"),
    ("{% if 1 == 1 %}yes{% else %}{{ unknown }}{% endif %}", {}, "yes"),
])
def test_language(source, env, want):
    assert render(source, **env) == want


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if a %}", "{{ a b }}", "{{ f('x') }}", "{% endif %}",
                                    "{% include 'x' %}", "{{ 'x'|nofilter }}", "{% if a %}{% else %}{% elif b %}{% endif %}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        render(source, a="")


def test_sandbox():
    for source in ("{{ s.upper }}", "{{ s.__class__ }}", "{{ o.x }}", "{{ o['__class__'] }}"):
        with pytest.raises(TemplateError):
            render(source, s="text", o=object())
    assert render("{{ d.keys }}", d={"a": 1}) == ""


def test_constants_are_folded():
    body = Compiler().folded(parse("a{% if 1 == 2 %}{{ x }}{% else %}{{ 'b'|upper }}{% endif %}c{% if x %}{{ 'd' + 'e' }}f{% endif %}"))
    assert body == [("const", "aBc"), ("if", [(("name", "x"), [("const", "def")])], [])]


controls = st.sampled_from([*op05.CONTROLS, "\\", "<\\/s>", "[", "]", "<", "INST", "x", "s>", "\\\\", "<|im_", "end|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(controls, max_size=8).map("".join))
def test_escaping_is_reversible_and_hides_controls(text):
    escaper = op05.Escaper(op05.CONTROLS)
    hidden = escaper.escape(text)
    assert escaper.unescape(hidden) == text and not escaper.plain.search(hidden)


def test_conversations_read_back(spark):
    r = rng()
    rows = []
    for conv in range(30):
        for turn in range(r.choice([1, 2, 7, 300])):
            role = r.choice(["user", "assistant", "system", None, "<|im_sep|>"])
            text = r.choice(["", None, "</s>[INST] ok [/INST]", "é <|im_end|>\n<\\|im_end|>", " ".join(words(r, 300))])
            rows.append((conv, turn, role, text, 1, "x"))
    rows += [(50, 1, "assistant", "b", 1, "x"), (50, 1, "assistant", "a", 1, "x"), (50, None, "user", "first", 1, "x"),
             (50, 1, "assistant", "a", 1, "x"), (None, 0, "assistant", "z" * 700_000, 1, "x"), (None, 1, "user", "q", 1, "x")]
    shuffled = rows[:]
    r.shuffle(shuffled)
    formatted = op05.format_conversations(spark.createDataFrame(shuffled, TURNS))
    got = {x.conv_id: x for x in op05.read_back(formatted).collect()}
    by = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    escaper = op05.Escaper(op05.CONTROLS)
    for c, turns in by.items():
        x = got[c]
        assert x.n_turns == len(turns)
        said = "".join(t for role, t in turns if role == "assistant")
        assert (x.loss_chars, x.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert x.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        body = sum(len(escaper.escape(a)) + len(escaper.escape(b)) + 33 for a, b in turns)
        assert x.formatted_chars == body + 7
    texts = {}
    for x in sorted(formatted.collect(), key=lambda x: x.piece):
        assert x.start == len(texts.get(x.conv_id, ""))
        texts[x.conv_id] = texts.get(x.conv_id, "") + x.text
    assert all(t.startswith("<s>") and t.endswith("</s>") for t in texts.values())


def test_empty_table(spark):
    formatted = op05.format_conversations(spark.createDataFrame([], TURNS))
    assert op05.read_back(formatted).count() == 0
