import time

import pytest

from copyrisk.llm.html_blocks import blocks
from copyrisk.llm.html_text import labelled_pages, train_field

BROKEN = {
    "open quote": '<p x="' * 800_000, "open tag": "<a " * 1_600_000, "open end tag": "</p " * 1_200_000, "quoted ends": '<a "x>" ' * 200_000 + "'", "comments": "<!--" * 1_200_000, "scripts": "<script>" * 600_000,
    "deep": "<div class=c><p>x" * 60_000, "no list": "<div>" * 60_000 + "<dt></dt>x" * 60_000, "list far up": "<ul><li><ul>" + "<div>" * 60_000 + "<li>x</li>" * 60_000, "stray ends": "<div>" * 60_000 + "</p>x" * 100_000, "names": "".join(f"<div class=w{i}>t" for i in range(60_000)),
}


@pytest.fixture(scope="module")
def field():
    return train_field(labelled_pages(20))


@pytest.mark.parametrize("name", BROKEN)
def test_time_grows_with_the_page(field, name):
    began = time.time()
    page = blocks(BROKEN[name])
    field.decode(page, {})
    assert time.time() - began < 20  # seconds, where the square of the length would take hours


def test_broken_markup_keeps_its_text():
    assert [b.text for b in blocks('<p class="a>b">one<p x="two <b>three</b>')] == ["one", 'three']
    assert [b.text for b in blocks("a < b <!-- gone")] == ["a < b"]
    assert [b.text for b in blocks("<ul><li>x<li>y</ul></p>z<script>if (a<b)")] == ["x", "y", "z"]
    assert [b.path for b in blocks("<div class='Main-Nav'><p>x<p>y</div>")] == [(("div", "main nav"), ("p", "")), (("div", "main nav"), ("p", ""))]
