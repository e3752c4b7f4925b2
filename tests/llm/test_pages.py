"""Page texts: the distribution by brute force, elements that readers don't see, and texts made to be slow."""

import random
import time

import pytest

from terraloom.llm import html_text

LONG = [f"Paragraph {i} of the article, which goes on for a good while and says what there is to say about it." for i in range(6)]


def paragraphs(part):
    return "".join(f"<p>{p}</p>" for p in part)


def test_stretch_by_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        sizes = [rnd.choice([0, 0, 3, 9, 40, 90, 200]) for _ in range(rnd.randint(1, 24))]
        if not any(sizes):
            continue
        n = len(sizes)
        blocks = [sum(sizes[j] for j in range(n) if -1 <= j - i <= 1) for i in range(n)]
        level = min(html_text.LEVEL, sum(b * s for b, s in zip(blocks, sizes)) / sum(sizes) / 8)
        gain = {(i, j): sum(blocks[i:j]) - level * (j - i) for i in range(n) for j in range(i + 1, n + 1)}
        start, end = html_text._stretch(sizes, 3)
        assert abs(gain[start, end] - max(gain.values())) < 1e-6
        # surge and dive: the ends stand above the level, and what borders on them doesn't pay
        assert blocks[start] > level and blocks[end - 1] > level


@pytest.mark.parametrize("hide", ["hidden", "HIDDEN=''", "style='color:red; display: none'", 'style="visibility:hidden"', "aria-hidden=true"])
def test_what_readers_do_not_see_goes(hide):
    page = f"<body><div>{paragraphs(LONG[:3])}<div {hide}><p>Never shown to anyone, however long it may be.</p></div>{paragraphs(LONG[3:])}</div></body>"
    assert html_text.main_text(page) == "\n".join(LONG)


@pytest.mark.parametrize("shown", ["title='hidden'", "data-hidden=1", "class='unhidden'", "style='display:block' title='none'"])
def test_words_in_other_attributes_hide_nothing(shown):
    page = f"<body><div><div {shown}>{paragraphs(LONG)}</div></div></body>"
    assert html_text.main_text(page) == "\n".join(LONG)


def test_the_distribution_decides_where_marks_do_not():
    """Unmarked menus and links around an unmarked article: all lines are alike by tag and class."""
    menu = "".join(f"<div>{w}</div>" for w in ("Home", "News", "Sport", "Weather", "About", "Contact", "Help", "Login"))
    links = "".join(f"<div><a href='/{i}'>Another story of this very site, number {i}</a></div>" for i in range(8))
    page = f"<body>{menu}{links}<div>{paragraphs(LONG)}</div>{links}{menu}</body>"
    got = html_text.main_text(page).split("\n")
    every = [t for t, *_ in html_text.lines(page)]
    assert set(LONG) <= set(got) and len(got) <= len(LONG) + 2 < len(every)
    assert not {"Home", "Sport", "Login"} & set(got)


@pytest.mark.parametrize("name", ["has-sidebar", "main-teaser", "without-ads"])
def test_names_of_wrappers_decide_nothing(name):
    page = f"<body><nav>Home</nav><div class='{name}'>{paragraphs(LONG)}</div><div class='main-teaser'><p>Other.</p></div></body>"
    assert html_text.main_text(page).split("\n")[: len(LONG)] == LONG


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"", "<!", "<script ", "</b>", "<", "<!--", "&amp", "<div class=", '<div style="', "<div hidden ", "<div>", "</div>"])
def test_pages_made_to_be_slow_take_a_time_in_proportion(part):
    took = []
    for n in (100_000, 400_000):
        page = part * (n // len(part))
        start = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_unmatched_ends_and_deep_nesting():
    page = "<div>" * 20_000 + "</x>" * 20_000 + paragraphs(LONG) + "</div>" * 30_000
    assert html_text.main_text(page) == "\n".join(LONG)


def test_unclosed_markup_loses_no_text_before_it():
    assert html_text.main_text("<p>First words<p>and more<script>var x = '<p>'") == "First words\nand more"
    assert html_text.main_text("<p>a < b and c<d></p>") == "a < b and c"
    assert html_text.main_text('<p title="it is > this">Text</p>') == "Text"
