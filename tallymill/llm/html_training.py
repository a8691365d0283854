"""Labelled pages for the block model, made by rule: known parts in random order, nesting, naming and carelessness."""

from __future__ import annotations

import random

_SYLLABLES = "an ber co de en fer gi hol in ka lo men nor os pra qui ren sta to un vel".split()
# Names that pages give to their parts.
_BOILERPLATE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs pagination pager toc",
    "header": "header masthead banner logo branding top site",
    "footer": "footer bottom copyright legal credits colophon imprint",
    "aside": "sidebar aside widget related recommended trending popular tags side rail",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner teaser",
    "notice": "cookie cookies notice consent gdpr alert warning popup modal overlay message disclaimer",
    "form": "form search newsletter subscribe login signup contact",
    "comments": "comments comment discussion replies reply responses reviews disqus respond feedback",
    "share": "share social sharing follow buttons toolbar meta byline",
}
# Phrases of lines that no article has, also where nothing around tells.
_PHRASES = {
    "footer": ("Copyright {} {}.", "© {} {}", "All rights reserved. {} {}", "© {} {}. All rights reserved."),
    "notice": ("We use cookies. {} {}", "{} {} cookie policy.", "Accept cookies {} {}", "Privacy policy {} {}"),
}
_SPOKEN_OF = ("cookie", "copyright", "©", "newsletter", "advert", "to log in", "subscribe")
_MAIN = "content article post entry main story body text post entry page"
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choice(_SYLLABLES) for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(1, 16).capitalize() + self.rng.choice("...?!") for _ in range(self.rng.randint(low, high)))

    def leaf(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        end = "" if tag in ("p", "li") and self.rng.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{attributes}>{text}{end}")
        self.labels.append(label)

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def phrase(self, kind: str) -> str:
        return self.rng.choice(_PHRASES[kind]).format(self.rng.randint(1990, 2030), self.words(1, 6))

    def bare(self) -> None:
        """A line under no name that tells: cells, paragraphs or small print."""
        kind = self.rng.choice(list(_PHRASES))
        opened, closed = self.rng.choice([("<table><tr><td>", "</td></tr></table>"), ("<p>", "</p>"), ("<div>", "</div>"), ("<center>", "</center>")])
        self.out.append(f"{opened}{self.phrase(kind)}{closed}")
        self.labels.append(0)

    def boilerplate(self, kind: str) -> None:
        rng = self.rng
        name = rng.choice(_BOILERPLATE[kind].split())
        plain = rng.random() < 0.25  # the tag alone tells
        tag = _TAGS.get(kind, "div") if plain or rng.random() < 0.5 else rng.choice(["div", "section", "div"])
        if tag in ("div", "section"):
            plain = False
        attribute = "" if plain else rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{self.word()}"', f" class='{name} x'"])
        self.out.append(f"<{tag}{attribute}>")
        shape = rng.random()
        if kind in ("nav", "share") or shape < 0.15:
            self.out.append("<ul>")
            for _ in range(rng.randint(2, 7)):
                self.leaf("li", self.link(self.words(1, 2)), 0)
            self.out.append("</ul>")
        elif kind == "form":
            self.leaf("label", self.words(1, 3), 0)
            self.out.append('<input type="text">')
            self.leaf("button", self.words(1, 2), 0)
        elif kind == "comments":
            self.leaf("h3", self.words(1, 3), 0)
            for _ in range(rng.randint(1, 4)):
                self.out.append('<div class="comment">' if rng.random() < 0.5 else "<div>")
                self.leaf("p", self.sentences(1, 4), 0)
                self.out.append("</div>")
        elif shape < 0.45:
            self.out.append(self.phrase(kind) if kind in _PHRASES and rng.random() < 0.5 else self.sentences(1, 3))
            self.labels.append(0)
        else:
            if rng.random() < 0.5:
                self.leaf(rng.choice(["h2", "h3", "h4", "div", "span-p"]).replace("span-p", "p"), self.words(1, 5), 0)
            for _ in range(rng.randint(1, 3)):
                self.leaf("p", self.sentences(1, 3) if rng.random() < 0.7 else self.link(self.words(2, 8)), 0)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        semantic = rng.random() < 0.7
        tag = rng.choice(["article", "article", "main"]) if semantic else "div"
        name = rng.choice(_MAIN.split())
        in_table = rng.random() < 0.15  # pages laid out by tables name nothing
        if in_table:
            tag = "td"
            self.out.append("<table><tr>")
            if rng.random() < 0.5:
                self.leaf("td", " | ".join(self.link(self.words(1, 2)) for _ in range(rng.randint(2, 5))), 0)
            self.out.append("<td>")
        else:
            self.out.append(f"<{tag}>" if semantic and rng.random() < 0.6 else f'<{tag} class="{name}">')
        if rng.random() < 0.8:
            self.leaf("h1", self.words(1, 10), 1)
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.74:
                text = self.sentences(1, 6) if rng.random() < 0.85 else self.words(1, 4) + "."
                text = f"<b>{text}<br>" if rng.random() < 0.12 else text
                if rng.random() < 0.12:  # an article may speak of such things
                    text = f"{self.words(1, 5)} {rng.choice(_SPOKEN_OF)} {text}"
                self.leaf("p", text if rng.random() < 0.85 else f"{text} {self.link(self.words(1, 3))} {self.words(2, 6)}", 1)
            elif kind < 0.8:
                self.leaf(rng.choice(["h2", "h3"]), self.words(1, 6), 1)
            elif kind < 0.86:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.leaf("li", self.sentences(1, 2), 1)
                self.out.append("</ul>")
            elif kind < 0.9:
                self.leaf("blockquote", self.sentences(1, 2), 1)
            else:
                self.boilerplate(rng.choice(["ad", "ad", "aside", "share", "notice", "form"]))
        if rng.random() < 0.2:
            self.boilerplate("comments")
        self.out.append(f"</{tag}>" + ("</tr></table>" if in_table else ""))


def labelled_pages(count: int = 600, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages with a label per leaf block, 1 for main text."""
    rng, pages = random.Random(seed), []
    for _ in range(count):
        page = _Page(rng)
        page.out.append("<!DOCTYPE html><html><head>")
        page.leaf("title", page.words(1, 9), 0)
        page.out.append("<style>p{}</style><script>var a='<p>';</script></head><body>")
        before = [k for k in ("header", "nav", "ad", "notice", "form", "aside", "share") if rng.random() < 0.35]
        after = [k for k in ("comments", "aside", "ad", "form", "share", "notice", "footer") if rng.random() < 0.4]
        rng.shuffle(before)
        for kind in before:
            page.boilerplate(kind)
        if rng.random() < 0.96:
            page.article()
        for kind in after:
            page.boilerplate(kind)
        if rng.random() < 0.25:
            page.bare()
        page.out.append(rng.choice(["</body></html>", ""]))
        pages.append((rng.choice(["", "\n"]).join(page.out), page.labels))
    return pages
