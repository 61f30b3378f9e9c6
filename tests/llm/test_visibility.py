"""What styles, attributes and elements hide, as browsers have it."""

import random

import pytest

from emberline.llm import html_text

STYLES = {
    "display:none;display:block": "shown", "display:block;display:none": "", "visibility:hidden;visibility:visible": "shown", "visibility:visible;visibility:hidden": "",
    "content:';display:none'": "shown", "background:url(a;display:none)": "shown", "/*;display:none;*/color:red": "shown", "/* a */display/**/:/* b */none": "", "display:none!important;display:block": "",
    "display:block ! important;display:none": "shown", "display:nonsense": "shown", "display:none;display:nonsense": "", "DISPLAY : NONE": "", "display:none;": "", ";;display:none": "", "xdisplay:none": "shown",
    "--display:none": "shown", "display:inline flex": "shown", "visibility:collapse": "", "visibility:inherit": "shown", "display:none;visibility:visible": "", "content:\"a\\\";display:none\"": "shown",
    "{display:none}": "shown", "display:none;visibility": "", "display": "shown", "": "shown", "content:'unclosed;display:none": "shown", "/* unclosed ;display:none": "shown",
}


@pytest.mark.parametrize("style", STYLES)
def test_declarations_in_order(style):
    quoted = style.replace("&", "&amp;").replace('"', "&quot;")
    assert html_text.render(f'<div style="{quoted}">shown</div>') == STYLES[style]


@pytest.mark.parametrize(("page", "want"), [
    ("<dialog>no</dialog>x", "x"), ("<dialog open>yes</dialog>", "yes"), ("<dialog style='display:block'>yes</dialog>", "yes"), ("<span hidden style='display:inline'>yes</span>", "yes"), ("<span hidden style='display:revert'>no</span>x", "x"),
    ("<ruby>a<rp>(</rp><rt>b</rt><rp>)</rp></ruby>", "ab"), ("<progress>70 %</progress><meter>2</meter>x", "x"),
    ("<input placeholder=Name><input type=button placeholder=no><input type=checkbox placeholder=no><input value=v placeholder=no>", "Name v"), ("<textarea placeholder=hint></textarea>", "hint"), ("<textarea placeholder=no>t</textarea>", "t"),
    ("<div style='visibility:hidden'>no<b style='visibility:initial'>yes</b><i style='visibility:inherit'>no</i></div>", "yes"),
])
def test_elements(page, want):
    assert html_text.render(page) == want


def test_details():
    got = html_text.render("<details>no<summary>Title <b>here</b></summary>no<p>no</p><summary>no</summary></details><details open><summary>More</summary>body</details>end").split()
    assert got == ["Title", "here", "More", "body", "end"]


def test_random_trees_against_a_walk():
    """Nested boxes with any of the rules; a walk that knows only the rules says which words show."""
    rng = random.Random(11)
    for _ in range(150):
        words = iter(range(10**6))

        def make(depth, shown, seen, words=words):
            out, want = [], []
            for _ in range(rng.randrange(1, 4)):
                w = f"w{next(words)}"
                out.append(f" {w} ")
                want += [w] if shown and seen else []
                if depth < 5 and rng.random() < 0.7:
                    kind = rng.choice(["plain", "none", "shown", "hide", "show", "attribute", "dialog", "open"])
                    style = {"none": "display:block;display:none", "shown": "display:none;display:block", "hide": "visibility:hidden", "show": "visibility:hidden;visibility:visible"}.get(kind, "")
                    extra = {"attribute": " hidden", "open": " open"}.get(kind, "")
                    tag = "dialog" if kind in ("dialog", "open") else rng.choice(["div", "span", "section"])
                    inside, more = make(depth + 1, shown and kind not in ("none", "attribute", "dialog"), False if kind == "hide" else True if kind == "show" else seen)
                    out.append(f"<{tag} style='{style}'{extra}>{inside}</{tag}>")
                    want += more
            return "".join(out), want

        page, want = make(0, True, True)
        assert html_text.render(page).split() == want
