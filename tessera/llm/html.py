"""Main text of web pages by a tree-structured graphical model.

The nodes of a page's element tree and its runs of text are variables with the states mixed, content and
boilerplate. Potentials join each with its parent, features of tag, names, links and length speak for its own
state. Sum-product messages upward and downward give every run's marginal; runs more likely content are kept.
Weights start from counts on labelled pages and are trained there on the gradient of the labels' likelihood, whose
expectations the same messages give.
"""

from __future__ import annotations

import html as entities
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import durable

MIXED, CONTENT, BOILERPLATE = range(3)

# Fixed sets of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not shown as text up to their end tag; where there is none, scripts and styles reach to the page's end and the others
#: are no more than a tag.
RAW = frozenset("script style noscript template iframe svg noembed noframes title".split())
RAW_TO_END = frozenset("script style".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math object q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var mi mn mo ms mtext mrow msup msub mfrac msqrt semantics".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "thead": ("tbody", "thead"), "tbody": ("tbody", "thead"),
}
SCOPES = frozenset("ul ol dl table select body article section div".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|ad\b")
SENTENCE_END = re.compile(r"[.!?…。][\"')\]]?(?:\s|$)")


@dataclass
class Node:
    parent: int
    tag: str
    names: tuple[str, ...] = ()
    role: str = ""
    hidden: bool = False
    label: str = ""
    leaf: bool = False
    chars: int = 0
    linked: int = 0
    pieces: list[tuple[int, str]] = field(default_factory=list)  # (block, text) of a run


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def parse(page: str) -> list[Node]:
    """The page's tree, parents first: elements that are blocks or have names, and runs of text.

    Plain inline elements add no node. A run ends where its node or block does. Text in elements that are not shown
    as text (scripts, styles, the title and the like) and comments is left out.
    """
    nodes = [Node(-1, "root")]
    stack: list[tuple[str, int]] = [("root", 0)]  # open elements, and the node text in them belongs to
    opened: dict[str, list[int]] = defaultdict(list)  # where in the stack elements of each name are
    blocks, scopes = [0], [0]  # where block elements and scopes are
    endless: set[str] = set()  # raw elements without an end tag in what is left
    links = block = position = 0
    run = -1

    def text(raw: str) -> None:
        nonlocal run
        if not raw:
            return
        owner = stack[-1][1]
        if run < 0 or nodes[run].parent != owner:
            if raw.isspace() and run < 0:
                return
            nodes.append(Node(owner, "#text", leaf=True))
            run = len(nodes) - 1
        shown = entities.unescape(raw)
        size = len(shown) - shown.count(" ")
        nodes[run].pieces.append((block, shown))
        nodes[run].chars += size
        nodes[run].linked += size if links else 0

    def close(depth: int) -> None:
        nonlocal links, block, run
        for tag, _ in reversed(stack[depth:]):
            opened[tag].pop()
            links -= tag == "a"
            if tag not in INLINE:
                block += 1
                run = -1
                blocks.pop()
                if tag in SCOPES:
                    scopes.pop()
        del stack[depth:]

    def push(tag: str, node: int) -> None:
        opened[tag].append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
            if tag in SCOPES:
                scopes.append(len(stack))
        stack.append((tag, node))

    while match := TOKEN.search(page, position):
        text(page[position:match.start()])
        position = match.end()
        if match[1]:
            tag = match[1].lower()
            if not opened[tag]:
                if tag in ("p", "br"):
                    block += 1
                    run = -1
                continue
            if tag not in INLINE or opened[tag][-1] > blocks[-1]:
                close(opened[tag][-1])
            continue
        tag = (match[2] or match[4] or "").lower()
        if not tag:
            continue
        raw = match[3] if match[2] else match[5]
        if tag in RAW:
            if not raw.endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, position)
                if end:
                    position = end.end()
                elif tag in RAW_TO_END:
                    position = len(page)
                else:
                    endless.add(tag)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                block += 1
                run = -1
            continue
        if tag in CLOSES_PARAGRAPH and opened["p"]:
            if opened["p"][-1] == blocks[-1]:
                close(blocks[-1])
        elif tag in SIBLINGS:
            depth = max((opened[other][-1] for other in SIBLINGS[tag] if opened[other]), default=0)
            if depth > scopes[-1]:
                close(depth)
        found = _attributes(raw)
        names = tuple(dict.fromkeys(
            part.lower() for key in ("class", "id") for part in NAME_PART.findall(found.get(key, ""))
        ))
        inline = tag in INLINE
        if not inline:
            block += 1
            run = -1
        if inline and not names and "role" not in found and "data-label" not in found:
            links += tag == "a"
            push(tag, stack[-1][1])
            continue
        style = found.get("style", "").replace(" ", "").lower()
        hidden = "hidden" in found or "display:none" in style or found.get("aria-hidden") == "true"
        nodes.append(Node(stack[-1][1], tag, names, found.get("role", "").lower(), hidden, found.get("data-label", "")))
        links += tag == "a"
        push(tag, len(nodes) - 1)
    text(page[position:])
    for index in range(len(nodes) - 1, 0, -1):
        nodes[nodes[index].parent].chars += nodes[index].chars
        nodes[nodes[index].parent].linked += nodes[index].linked
    return nodes


def _bucket(size: int) -> int:
    return min(9, size.bit_length())


def features(node: Node, nodes: list[Node]) -> list[str]:
    """What a node shows of itself; names are parts of its class and id."""
    density = 0 if not node.linked else 1 + min(3, 4 * node.linked // max(1, node.chars))
    above = nodes[node.parent]
    if node.leaf:
        shown = "".join(p for _, p in node.pieces).strip()
        ends = sum(1 for _ in islice(SENTENCE_END.finditer(shown), 3))
        return [
            f"in {above.tag}", f"length {_bucket(node.chars)}", f"links {density}", f"ends {ends}",
            f"stop {shown[-1:] in '.!?…”'}", *(["copyright"] if "©" in shown else []),
        ]
    out = [f"tag {node.tag}", f"tags {above.tag} {node.tag}", f"links {density}", f"length {_bucket(node.chars)}"]
    out += [f"name {n}" for n in node.names]
    if node.role:
        out.append(f"role {node.role}")
    if node.hidden:
        out.append("hidden")
    return out


# --- model --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HtmlConfig:
    """``pseudo`` is added to every count; features seen less than ``least`` times say nothing.

    Training takes ``rounds`` of ``epochs`` in each of ``shards`` parts, whose weights are averaged by round.
    """

    pseudo: float = 0.3
    least: int = 3
    content: float = 0.5
    shards: int = 4
    rounds: int = 3
    epochs: int = 3
    rate: float = 0.4
    start: float = 0.5


Weights = dict[str, list[float]]


def infer(
    nodes: list[Node], own: list[list[float]], to_element: list[list[float]], to_run: list[list[float]]
) -> tuple[list[list[float]], list[list[float]]]:
    """Marginals of every node, and of its parent without it, by sum-product on the tree.

    ``own`` holds each node's potentials by state and is multiplied by what comes from below.
    """
    count = len(nodes)
    up: list[list[float]] = [[]] * count
    for i in range(count - 1, 0, -1):
        a, b, c = own[i]
        total = a + b + c or 1.0
        a, b, c = a / total, b / total, c / total
        own[i] = [a, b, c]
        moves = to_run if nodes[i].leaf else to_element
        x, y, z = (m[0] * a + m[1] * b + m[2] * c for m in moves)
        total = x + y + z or 1.0
        up[i] = [x / total, y / total, z / total]
        parent = own[nodes[i].parent]
        x, y, z = parent[0] * up[i][0], parent[1] * up[i][1], parent[2] * up[i][2]
        total = x + y + z or 1.0
        own[nodes[i].parent] = [x / total, y / total, z / total]
    whole: list[list[float]] = [own[0]] + [[]] * (count - 1)
    above: list[list[float]] = [[]] * count
    for i in range(1, count):
        moves = to_run if nodes[i].leaf else to_element
        rest = [p / max(m, 1e-12) for p, m in zip(whole[nodes[i].parent], up[i], strict=True)]
        total = rest[0] + rest[1] + rest[2] or 1.0
        above[i] = rest = [rest[0] / total, rest[1] / total, rest[2] / total]
        belief = [(rest[0] * moves[0][s] + rest[1] * moves[1][s] + rest[2] * moves[2][s]) * own[i][s] for s in range(3)]
        total = belief[0] + belief[1] + belief[2] or 1.0
        whole[i] = [belief[0] / total, belief[1] / total, belief[2] / total]
    return whole, above


@dataclass(frozen=True)
class PageModel:
    """Weights of features by state for elements and runs, and log-potentials from a parent's state to theirs."""

    element: Weights
    run: Weights
    to_element: list[list[float]]
    to_run: list[list[float]]

    def own(self, nodes: list[Node], names: list[list[str]]) -> list[list[float]]:
        """Potentials of each node by its features alone."""
        out = []
        for node, own in zip(nodes, names, strict=True):
            table = self.run if node.leaf else self.element
            a = b = c = 0.0
            for name in own:
                if weights := table.get(name):
                    a, b, c = a + weights[0], b + weights[1], c + weights[2]
            top = max(a, b, c)
            out.append([math.exp(a - top), math.exp(b - top), math.exp(c - top)])
        return out

    def moves(self) -> tuple[list[list[float]], list[list[float]]]:
        return tuple([[math.exp(max(-60.0, x)) for x in row] for row in t] for t in (self.to_element, self.to_run))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is content."""
        names = [[], *(features(node, nodes) for node in nodes[1:])]
        element, run = self.moves()
        return [w[CONTENT] for w in infer(nodes, self.own(nodes, names), element, _runs(run))[0]]

    def main_text(self, page: str, config: HtmlConfig) -> str:
        """Content runs in page order: white space in a block made one space, blocks joined by one."""
        nodes = parse(page)
        shares = self.marginals(nodes)
        blocks: dict[int, list[str]] = {}
        for node, share in zip(nodes, shares, strict=True):
            if node.leaf and share >= config.content:
                for block, piece in node.pieces:
                    blocks.setdefault(block, []).append(piece)
        joined = (" ".join("".join(blocks[b]).split()) for b in sorted(blocks))
        return " ".join(b for b in joined if b)


def _states(nodes: list[Node]) -> list[int]:
    """State of every node of a labelled page; a label holds for all below until another."""
    labels = [""] * len(nodes)
    seen: list[set[str]] = [set() for _ in nodes]
    for i, node in enumerate(nodes):
        labels[i] = node.label or (labels[node.parent] if i else "boilerplate")
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].leaf or not seen[i]:
            seen[i].add(labels[i])
        if i:
            seen[nodes[i].parent] |= seen[i]
    return [MIXED if len(s) > 1 else CONTENT if s == {"content"} else BOILERPLATE for s in seen]


def _runs(moves: list[list[float]]) -> list[list[float]]:
    """A run of text is never mixed."""
    return [[0.0, *row[1:]] for row in moves]


def _examples(pages: list[str]) -> list[tuple[list[Node], list[list[str]], list[int]]]:
    out = []
    for page in pages:
        nodes = parse(page or "")
        out.append((nodes, [[], *(features(node, nodes) for node in nodes[1:])], _states(nodes)))
    return out


def counted(labelled: DataFrame, config: HtmlConfig = HtmlConfig()) -> PageModel:
    """Weights and potentials from counts: a grouped sum of features and of parent's states by own state.

    The driver gets a row for each feature and state of the labelled pages, so the model's size is that of their
    vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                ("run" if node.leaf else "element", name, states[i])
                for nodes, names, states in _examples(batch.column("html").to_pylist())
                for i, node in enumerate(nodes) if i
                for name in [*names[i], "*", f"> {states[node.parent]}"]
            ]
            kinds, names, states = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(states, pa.int32())],
                names=["kind", "name", "state"],
            )

    rows = labelled.select("html").mapInArrow(run, "kind string, name string, state int")
    counts: dict[str, Weights] = {"element": {}, "run": {}}
    for row in rows.groupBy("kind", "name", "state").agg(F.count("*").alias("n")).collect():
        counts[row["kind"]].setdefault(row["name"], [0.0, 0.0, 0.0])[row["state"]] += row["n"]

    def weights(kind: str) -> Weights:
        total = counts[kind].get("*", [0.0, 0.0, 0.0])
        return {
            name: [config.start * math.log((seen[s] + config.pseudo) / (total[s] + 2 * config.pseudo)) for s in range(3)]
            for name, seen in sorted(counts[kind].items())
            if sum(seen) >= config.least and name != "*" and name[0] != ">"
        }

    def potentials(kind: str) -> list[list[float]]:
        above = [counts[kind].get(f"> {r}", [0.0, 0.0, 0.0]) for r in range(3)]
        return [[math.log((n + config.pseudo) / (sum(seen) + 3 * config.pseudo)) for n in seen] for seen in above]

    return PageModel(weights("element"), weights("run"), potentials("element"), potentials("run"))


def train_part(model: PageModel, pages: list[str], config: HtmlConfig) -> PageModel:
    """Adaptive steps up the gradient of the labels' likelihood, page by page: what is seen less what is expected."""
    examples = _examples(pages)
    tables = {False: {k: list(v) for k, v in model.element.items()}, True: {k: list(v) for k, v in model.run.items()}}
    joint = {False: [list(r) for r in model.to_element], True: [list(r) for r in model.to_run]}
    past = {leaf: {k: [1.0] * 3 for k in table} for leaf, table in tables.items()}
    past_joint = {leaf: [[1.0] * 3 for _ in range(3)] for leaf in (False, True)}
    for _ in range(config.epochs):
        for nodes, names, states in examples:
            now = PageModel(tables[False], tables[True], joint[False], joint[True])
            element, run = now.moves()
            run = _runs(run)
            own = now.own(nodes, names)
            whole, above = infer(nodes, own, element, run)
            slopes: dict[tuple[bool, str], list[float]] = {}
            slope_joint = {leaf: [[0.0] * 3 for _ in range(3)] for leaf in (False, True)}
            for i in range(1, len(nodes)):
                leaf, moves = nodes[i].leaf, run if nodes[i].leaf else element
                miss = [(s == states[i]) - whole[i][s] for s in range(3)]
                for name in names[i]:
                    if name in tables[leaf]:
                        slope = slopes.setdefault((leaf, name), [0.0, 0.0, 0.0])
                        for s in range(3):
                            slope[s] += miss[s]
                both = [[above[i][r] * moves[r][s] * own[i][s] for s in range(3)] for r in range(3)]
                total = sum(map(sum, both)) or 1.0
                for r in range(3):
                    for s in range(3):
                        slope_joint[leaf][r][s] -= both[r][s] / total
                slope_joint[leaf][states[nodes[i].parent]][states[i]] += 1.0
            for (leaf, name), slope in slopes.items():
                for s in range(3):
                    past[leaf][name][s] += slope[s] ** 2
                    tables[leaf][name][s] += config.rate * slope[s] / math.sqrt(past[leaf][name][s])
            for leaf in (False, True):
                for r in range(3):
                    for s in range(3):
                        past_joint[leaf][r][s] += slope_joint[leaf][r][s] ** 2
                        joint[leaf][r][s] += config.rate * slope_joint[leaf][r][s] / math.sqrt(past_joint[leaf][r][s])
    return PageModel(tables[False], tables[True], joint[False], joint[True])


def _mean(models: list[PageModel]) -> PageModel:
    def rows(tables: list) -> list:
        return [[sum(t[r][s] for t in tables) / len(tables) for s in range(3)] for r in range(3)]

    def names(tables: list[Weights]) -> Weights:
        return {k: [sum(t[k][s] for t in tables) / len(tables) for s in range(3)] for k in tables[0]}

    return PageModel(
        names([m.element for m in models]), names([m.run for m in models]),
        rows([m.to_element for m in models]), rows([m.to_run for m in models]),
    )


def fit(labelled: DataFrame, config: HtmlConfig = HtmlConfig()) -> PageModel:
    """Train on a bounded set of pages (html) whose elements carry ``data-label`` content or boilerplate."""
    labelled = labelled.select("html")
    model = counted(labelled, config)
    shard = F.pmod(F.xxhash64("html"), F.lit(config.shards)).alias("shard")
    table = durable(labelled.groupBy(shard).agg(F.array_sort(F.collect_list("html")).alias("pages")))
    for _ in range(config.rounds):
        def train(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, pages in zip(batch.column("shard"), batch.column("pages"), strict=True):
                    state = pickle.dumps(train_part(model, pages.as_py(), config).__dict__)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.as_py()]), pa.array([state], pa.binary())], names=["shard", "state"]
                    )

        parts = table.mapInArrow(train, "shard long, state binary").collect()  # one model per shard
        if not parts:
            break
        model = _mean([PageModel(**pickle.loads(bytes(p["state"]))) for p in sorted(parts, key=lambda p: p["shard"])])
    return model


def extract(pages: DataFrame, model: PageModel, config: HtmlConfig = HtmlConfig()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``, from its whole html.

    One pass without a shuffle; a task holds one page's tree. A null or empty page has the text ''. Repeated rows
    have equal results; other columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(own, config) if (own := value.as_py()) else "" for value in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
