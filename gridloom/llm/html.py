"""Main-text extraction by tree scoring.

The page is read into blocks (runs of text between block tags), each with its
path of open elements. A block passes points to its ancestors: one, one for
each comma, and one for each 100 characters up to three; the parent gets all,
the grandparent half, those above a shrinking share. Scores are discounted by
the share of text inside links. The best container wins; its siblings are kept
if they score a fifth of it, or are plain paragraphs. Elements that hold no
article (navigation, header, footer, aside, form, script, style ...) or whose
class, id or role says so (menu, advert, notice, comment ...) are left out.

Defined results: a null or empty page has empty text. Unclosed and misplaced
tags are tolerated as browsers do for paragraphs, lists and tables: a block tag
ends an open paragraph, an end tag closes up to its element if that is open and
is ignored otherwise. A page without any paragraph that scores yields all text
outside the left-out elements. Rows with null ids, repeated rows: each row is
extracted by itself. Further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from .workers import parts, task

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")

# HTML's element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = set("nav header footer aside form script style noscript template iframe svg math object button select option textarea input head title menu dialog canvas audio video map applet label datalist output progress meter search".split())
ENDS_PARAGRAPH = BLOCK
SAME_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}}
# Words of class, id and role that name what is no article text.
_NOT_ARTICLE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|adbox|adblock|adslot|banner|sponsor\w*|promo\w*|promoted|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscrib\w*|signup|login|share|sharing|social|"
    r"comments?|commentlist|disqus|replies|respond|discussion|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar|side|aside|rail|widgets?|related|recommend\w*|recirc|trending|footer|foot|masthead|header|topbar|toolbar|pager|pagination|paging|tags?|meta|byline|copyright|legal|disclaimer|"
    r"skip|hidden|search\w*|contentinfo|complementary|site-?header|site-?footer|feedback|reviews?|ratings?|shoutbox|outbrain|taboola)(?:$|[^a-z])"
)
_ARTICLE = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|page|post|text|story|blog)(?:$|[^a-z])")


class _Node:
    __slots__ = ("tag", "parent", "dropped", "score", "passed", "text", "linked", "bonus", "order", "block", "kept")

    def __init__(self, tag, parent, dropped, bonus, order):
        self.tag, self.parent, self.dropped, self.bonus, self.order = tag, parent, dropped, bonus, order
        self.score, self.passed, self.text, self.linked, self.kept = 0.0, 0.0, 0, 0, False
        #: The nearest block element, this one included.
        self.block = self if parent is None or tag in BLOCK else parent.block


def _attributes(tag: str, text: str) -> tuple[bool, float]:
    """Whether an element is left out, and its bonus."""
    if tag in DROPPED:
        return True, 0.0
    if not text:
        return False, 0.0
    names = []
    for key, a, b, c in _ATTR.findall(text):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id", "role"):
            names.append(value)
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, 0.0
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", text.lower()):
        return True, 0.0
    joined = " ".join(names)
    if not joined:
        return False, 0.0
    if tag not in ("html", "body", "article", "main") and _NOT_ARTICLE.search(joined) and not (tag in ("div", "section") and re.search(r"(?:^|\s)(?:article|post|entry|main|story)(?:$|[-_\s](?:body|content|text))", joined)):
        return True, 0.0
    return False, 25.0 if _ARTICLE.search(joined) else 0.0


def parse(page: str) -> tuple[list[_Node], list[tuple[str, _Node, int]]]:
    """Elements, and blocks (text, element, characters inside links). Counts of
    the open elements by name spare the searches that would find none, so deep
    nesting costs no more than its length."""
    root = _Node("#", None, False, 0.0, 0)
    nodes, blocks, stack = [root], [], [root]
    buffer: list[str] = []
    state = {"linked": 0}
    opened: dict[str, list[int]] = defaultdict(list)  # places in the stack
    containers: list[int] = []

    def flush():
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            if text:
                blocks.append((text, stack[-1].block, min(state["linked"], len(text))))
            buffer.clear()
            state["linked"] = 0

    def drop(upto: int):
        for x in reversed(stack[upto:]):
            if x.tag[0] != "#":
                opened[x.tag].pop()
            if x.tag in BLOCK:
                containers.pop()
        del stack[upto:]

    def close(upto: int):
        flush()
        drop(upto)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        cdata, slash, tag, attributes, text = m.groups()
        if text is None and cdata is not None:
            text = cdata
            if not stack[-1].dropped:
                buffer.append(text)
            continue
        if text is not None:
            if not stack[-1].dropped:
                text = html.unescape(text) if "&" in text else text
                buffer.append(text)
                if opened["a"]:
                    state["linked"] += len(text.strip())
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if not opened[tag]:
                if tag in ("p", "br"):
                    flush()
                continue
            k = opened[tag][-1]
            if tag in BLOCK:
                close(k)
            elif containers and containers[-1] > k:  # a block is open within: the element ends, but stays its parent
                opened[tag].pop()
                stack[k].tag = "#" + tag
            else:
                drop(k)
            continue
        if tag == "br":
            if not stack[-1].dropped:
                buffer.append(" ")
            continue
        # a paragraph that no other block is open within
        if tag in BLOCK and opened["p"] and opened["p"][-1] == containers[-1]:
            close(opened["p"][-1])
        if tag in SAME_CLOSES and any(opened[x] for x in SAME_CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPE[tag]:
                    break
                if stack[k].tag in SAME_CLOSES[tag]:
                    close(k)
                    break
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        dropped, bonus = _attributes(tag, attributes)
        node = _Node(tag, stack[-1], dropped or stack[-1].dropped, bonus, len(nodes))
        nodes.append(node)
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        stack.append(node)
        opened[tag].append(len(stack) - 1)
        if tag in BLOCK:
            containers.append(len(stack) - 1)
        if tag in RAW and tag not in ("svg", "math", "object"):
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else n
    close(1)
    flush()
    return nodes, blocks


def extract(page: str | None) -> str:
    """Main text of a page: its blocks, joined by line ends."""
    if not page:
        return ""
    nodes, blocks = parse(page)
    if not blocks:
        return ""
    for text, node, linked in blocks:
        node.text += len(text)
        node.linked += linked
        heading = len(node.tag) == 2 and node.tag[0] == "h"
        if len(text) < 25 or heading:
            continue
        worth = (1.0 + text.count(",") + min(len(text) // 100, 3)) * (1.0 - linked / len(text))
        up = node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") and node.parent is not None else node
        up.score += worth
    # children come after their parents: what they pass on arrives before it is passed on
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.text += node.text
            up.linked += node.linked
            up.passed += node.score / 2 + node.passed / 3
        node.score += node.passed
    for node in nodes:
        if node.score:
            extra = {"article": 25.0, "main": 15.0, "body": -5.0, "html": -5.0, "#": -5.0}.get(node.tag, 0.0) + node.bonus
            node.score = (node.score + extra) * (1.0 - node.linked / max(node.text, 1))
    best = max(nodes, key=lambda n: (n.score, -n.order))
    if best.score <= 0:
        return "\n".join(text for text, _, _ in blocks)
    best.kept = True
    beside = [n for n in nodes if n.parent is best.parent and n.text and best.parent is not None]
    chosen = {best.order}
    for node in beside:
        density = node.linked / node.text
        if node.score >= max(10.0, best.score * 0.2) or node.tag == "p" and (density < 0.25 and node.text > 80 or density == 0 and node.text > 25):
            node.kept = True
            chosen.add(node.order)
    for node in beside:  # headings, lists and short paragraphs between what is kept
        node.kept |= min(chosen) < node.order < max(chosen) and node.linked < 0.5 * node.text
    kept, inside = {}, {}
    for node in nodes:
        above = node.parent.order if node.parent is not None else None
        kept[node.order] = node.kept or (above is not None and kept[above])
        inside[node.order] = node is best or (above is not None and inside[above])
    out = []
    for text, node, _ in blocks:
        # beside the best container, lists of links are left out whole
        links = not inside[node.order] and node.tag in ("li", "ul", "ol") and node.linked > 0.8 * node.text
        if kept[node.order] and not links:
            out.append(text)
    return "\n".join(out)


def op9(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 2):
                texts = [extract(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(task("html", run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
