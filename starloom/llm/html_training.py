"""Labelled pages to learn from: made by rule, every element that holds main text marked data-main="1".

The rule varies layout, element kinds, class names, lengths and links, so that
what is learned are the roles of elements and names, not one site's template.
"""

from __future__ import annotations

import random

# Names that sites give to the parts of a page, by part.
NAMES = {
    "menu": "nav navbar menu navigation main-menu topnav breadcrumb breadcrumbs links pagination pager toc skip",
    "header": "header masthead site-header top banner logo branding topbar",
    "footer": "footer site-footer bottom copyright legal colophon credits",
    "side": "sidebar aside related widget rail secondary recommended popular trending more-stories tags author-box",
    "notice": "cookie consent notice gdpr alert popup modal overlay newsletter subscribe disclaimer paywall message",
    "advert": "ad ads advert advertisement sponsored promo banner-ad sponsor adsense adbox dfp",
    "form": "search login signup contact-form form poll survey",
    "share": "share social follow sharing buttons likes",
    "comments": "comments comment disqus replies responses discussion reply thread comment-list respond",
    "main": "content article post entry main story body text article-body post-content entry-content story-body page-content maincontent prose",
}
WORDS = "the of and to in is was for on that with as it at by from are this be or an which have not they but their one all were when we there can more if no out so said what up its about into than them only other new some time could these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()
TAGS = {"menu": ["nav", "div", "ul", "nav", "menu"], "header": ["header", "div", "header"], "footer": ["footer", "div", "footer"], "side": ["aside", "div", "section"], "notice": ["div", "section", "aside", "dialog"], "advert": ["div", "aside", "section", "ins"], "form": ["form", "div", "form"], "share": ["div", "ul"], "comments": ["section", "div", "ol", "div"]}


def _text(r: random.Random, n: int) -> str:
    words = [r.choice(WORDS) for _ in range(n)]
    for i in range(0, n, r.randint(6, 14)):
        words[i] = words[i].capitalize()
        if i:
            words[i - 1] += r.choice([".", ".", ",", "!"])
    return " ".join(words) + "."


def _names(r: random.Random, part: str) -> str:
    if r.random() < 0.3:
        return ""
    return f' {r.choice(["class", "class", "id"])}="{" ".join(r.sample(NAMES[part].split(), r.choice([1, 1, 2])))}"'


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_text(r, r.randint(1, 4))}</a></li>' for i in range(n))


def _heading(r: random.Random) -> str:
    return r.choice(["", "<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>", "<p>{}</p>"]).format(_text(r, r.randint(1, 5)))


def _other(r: random.Random, part: str) -> str:
    tag, names = r.choice(TAGS[part]), _names(r, part)
    if part in ("menu", "share"):
        inner = f"<ul>{_links(r, r.randint(2, 9))}</ul>" if tag not in ("ul", "menu") else _links(r, r.randint(2, 9))
    elif part == "comments":
        item = "li" if tag == "ol" else r.choice(["div", "article", "p"])
        inner = ("" if tag == "ol" else _heading(r)) + "".join(f"<{item}{_names(r, part)}>{r.choice(['<p>{}</p>', '<div>{}</div>', '{}', '<h4>anon</h4><p>{}</p>']).format(_text(r, r.randint(2, 60)))}</{item}>" for _ in range(r.randint(1, 6)))
    elif part == "form":
        inner = f'<label>{_text(r, 2)}</label><input name="q"><button>{_text(r, 1)}</button><p>{_text(r, r.randint(2, 10))}</p>'
    elif part == "side":
        inner = _heading(r) + (f"<ul>{_links(r, r.randint(2, 7))}</ul>" if r.random() < 0.6 else "".join(f"<p>{_text(r, r.randint(3, 80))}</p>" for _ in range(r.randint(1, 3))))
    elif part == "footer":
        inner = r.choice(["", f"<ul>{_links(r, 4)}</ul>"]) + r.choice(["<p>&copy; {}</p>", "&copy; {}", "<div>{}</div>"]).format(_text(r, r.randint(3, 20)))
    elif part == "header":
        inner = r.choice(['<div><a href="/">{}</a></div>', '<p>{}</p>', "<h1>{}</h1>", "{}"]).format(_text(r, r.randint(1, 6))) + r.choice(["", f"<nav><ul>{_links(r, 5)}</ul></nav>"])
    else:
        inner = r.choice(["", "", _heading(r)]) + r.choice(["{}", "<p>{}</p>", '<p>{}</p><button>ok</button>', '<a href="/x">{}</a>']).format(_text(r, r.randint(3, 50)))
        if part == "notice" and not names or part == "advert" and not names:
            names = f' class="{r.choice(NAMES[part].split())}"'
    if not names and tag == "div":
        names = f' class="{r.choice(NAMES[part].split())}"'
    return f"<{tag}{names}>{inner}</{tag}>"


def _main(r: random.Random) -> str:
    def block() -> str:
        kind = r.random()
        long = _text(r, r.choice([2, 3, 5, 12, 30, 60, 120]))
        if kind < 0.08:
            return f'<div data-main="1">{long}</div>'
        if kind < 0.7:
            return f'<p data-main="1">{long}</p>'
        if kind < 0.78:
            return f'<h{(h := r.choice([2, 3, 4]))} data-main="1">{_text(r, r.randint(1, 8))}</h{h}>'
        if kind < 0.86:
            items = "".join(f'<li data-main="1">{_text(r, r.randint(2, 20))}</li>' for _ in range(r.randint(1, 5)))
            return f'<ul data-main="1">{items}</ul>'
        if kind < 0.92:
            return f'<blockquote data-main="1"><p data-main="1">{long}</p></blockquote>'
        if kind < 0.96:
            return f'<table data-main="1"><tr data-main="1"><td data-main="1">{_text(r, 3)}</td><td data-main="1">{_text(r, 2)}</td></tr></table>'
        return f'<pre data-main="1">{_text(r, 8)}</pre>'

    head = f'<h1 data-main="1">{_text(r, r.randint(2, 9))}</h1>' if r.random() < 0.85 else ""
    if head and r.random() < 0.25:
        head = f'<header data-main="1">{head}</header>'
    blocks = [block() for _ in range(r.randint(1, 9))]
    if r.random() < 0.3:
        blocks.insert(r.randint(0, len(blocks)), _other(r, r.choice(["advert", "share", "side", "notice"])))
    tag = r.choice(["article", "article", "main", "div", "section"])
    names = _names(r, "main") or (f' class="{r.choice(NAMES["main"].split())}"' if tag in ("div", "section") else "")
    inner = head + "".join(blocks)
    if r.random() < 0.3:
        inner = f'<div data-main="1"{_names(r, "main")}>{inner}</div>'
    return f'<{tag}{names} data-main="1">{inner}</{tag}>'


def pages(count: int = 1500, seed: int = 7) -> list[str]:
    """The labelled pages: ``count`` of them, the same for the same seed."""
    r = random.Random(seed)
    out = []
    for _ in range(count):
        before = [_other(r, p) for p in ("notice", "header", "menu", "advert", "form") if r.random() < 0.5]
        after = [_other(r, p) for p in ("share", "side", "comments", "advert", "form", "menu", "notice") if r.random() < 0.4]
        r.shuffle(after)
        after += [_other(r, "footer")] if r.random() < 0.8 else []
        main = _main(r)
        if r.random() < 0.4:
            kind, cut = r.choice(["main", "div", "section"]), r.randint(0, len(after))
            main, after = f"<{kind}{r.choice(['', _names(r, 'main'), ' id=content', ' class=main'])}>{main}{''.join(after[:cut])}</{kind}>", after[cut:]
        bare = r.random() < 0.08  # no element of its own: the body holds the main text
        if bare:
            main = "".join(f'<p data-main="1">{_text(r, r.randint(5, 80))}</p>' for _ in range(r.randint(2, 9)))
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.4 and not bare:
            body = f"<div{r.choice(['', ' id=page', ' class=wrapper', ' class=container'])}>{body}</div>"
        out.append(f"<html><head><title>{_text(r, 4)}</title></head><body{' data-main=1' * bare}>{body}</body></html>")
    return out
