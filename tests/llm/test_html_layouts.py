"""Pages put together from a known article and known surroundings: the article comes out, and nothing else."""

import html
import itertools
import random

import pytest

from sectional.llm.html_text import main_text

ARTICLES = {
    "en": ["The history of the town is long, and it has been told in many of the books that were written about it.",
           "When the river was high, the people of the town went up to the hills and stayed there until it fell again."],
    "de": ["Die Geschichte der Stadt ist lang und wurde in vielen Büchern erzählt, die über sie geschrieben worden sind.",
           "Als der Fluss hoch stand, gingen die Menschen auf die Hügel und blieben dort, bis er wieder gefallen war."],
    "ru": ["История этого города очень длинная, и о ней рассказано во многих книгах, которые были написаны за последние сто лет.",
           "Когда вода в реке поднималась, жители уходили на холмы и оставались там, пока она снова не опускалась до обычного уровня."],
    "ja": ["この町の歴史はとても長く、これまでに書かれた多くの本の中で語られてきたが、いまでもその全体を知っている人はほとんどいないと言われている。",
           "川の水が高くなったとき、町の人々は丘の上へ行き、水がふたたび下がるまでの何日ものあいだ、そこで火を囲んで静かに暮らしていたという。"],
    "tr": ["Bu kasabanın tarihi çok uzundur ve son yüz yılda yazılmış olan birçok kitapta ayrıntılı olarak anlatılmıştır.",
           "Nehrin suyu yükseldiğinde kasabalılar tepelere çıkar ve su yeniden alçalıncaya kadar günlerce orada kalırlardı."],
}
CHROME = '<header class="masthead"><a href="/">Home</a> <a href="/b">News</a></header><nav><ul><li><a href="/c">Menu</a></li></ul></nav>'
TAIL = '<div class="related-posts"><p><a href="/x">Another story about something</a></p></div><footer><p>Contact us at the office. <a href="/p">Privacy</a></p></footer>'
LAYOUTS = {
    "article": "<body>{chrome}<article>{body}</article>{tail}</body>",
    "plain": "<body>{chrome}<div>{body}</div>{tail}</body>",
    "form": "<body><form action='/'>{chrome}<div>{body}</div>{tail}</form></body>",
    "widget": "<body>{chrome}<div class='elementor-widget widget'><div>{body}</div></div>{tail}</body>",
    "sidebar layout": "<body><div class='layout sidebar-right'>{chrome}<div class='content'>{body}</div></div>{tail}</body>",
    "main in a form": "<body><form>{chrome}<main>{body}</main></form>{tail}</body>",
}
EXTRAS = {
    "none": "", "link paragraph": '<p><a href="/more">More about the town and its history</a></p>', "anchor": "<a name=top>", "datalist": "<datalist id=d><option value=1>one<option>two</datalist>",
    "template": "<template><div><p>Hidden words that nobody is to see</p></div></template>", "select": "<select><option>First<option>Second</select>", "svg": "<svg><text>Drawn</text></svg>",
    "open option": "<p><option>lost",
}


@pytest.mark.parametrize("layout, language", list(itertools.product(LAYOUTS, ARTICLES)))
def test_the_article_comes_out(layout, language):
    rng = random.Random(layout + language)
    paragraphs = [" ".join(rng.choices(ARTICLES[language], k=rng.randint(1, 3))) + f" & {i}" for i in range(5)]
    want = "\n\n".join(paragraphs)
    for name, extra in EXTRAS.items():
        shown = [f"<p>{html.escape(p)}</p>" for p in paragraphs]
        page = LAYOUTS[layout].format(chrome=CHROME, tail=TAIL, body="".join([*shown[:2], extra, *shown[2:]]))
        assert main_text(page) == want, name


def test_a_long_comment_section_or_sidebar_is_no_article():
    article = "".join(f"<p>{p}</p>" for p in ARTICLES["en"])
    for box in ("<div class=comments>{}</div>", "<aside>{}</aside>", "<div class=sidebar>{}</div>", "<form>{}</form>"):
        page = f"<article>{article}</article>" + box.format("".join(f"<p>{ARTICLES['en'][0]} {i}</p>" for i in range(20)))
        assert main_text(page) == "\n\n".join(ARTICLES["en"])


def test_raw_text_without_an_end():
    good = ARTICLES["en"][0]
    assert main_text(f"<p>{good}<script>var x = 1; <p>{good}") == good
    assert main_text(f"<title>T<p>{good}") == f"T\n\n{good}" or main_text(f"<title>T<p>{good}").endswith(good)


def test_a_very_long_page():
    good = ARTICLES["en"][0]
    page = "<article>" + f"<p>{good}</p>" * 20_000 + "</article>"
    assert main_text(page) == "\n\n".join([good] * 20_000)
