"""Main text of web pages by template deduction: tokens of one occurrence vector over a host's pages are a class, valid classes nest
into the host's template, and what fills its slots is extracted."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, written
from kinweave.llm.simhash import _hashes
from kinweave.llm.urls import host_and_path

_token = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|textarea|title|svg|iframe|select|button)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<!?/?[a-zA-Z](?:[^>\"']|\"[^\"]{0,4000}\"|'[^']{0,4000}')*>|<[!?][^>]*>|</?[a-zA-Z][^>]*>|[^<]+|<",
    re.S | re.I,
)
_tag = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
_named = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
#: Elements that end a block; all others, unknown ones too, are within a line.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text, whatever they are called.
FURNITURE = frozenset("nav footer aside form dialog menu head search".split())
#: What class, id and role call such elements: the last word of a name, words in ENDINGS aside.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header menu nav "
    "navbar navigation newsletter notice notices popup promo related replies reply share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget complementary contentinfo search form".split()
)
ENDINGS = frozenset("area bar block body bottom box buttons container content inner item items left link links list main outer panel primary right secondary section slot text title top unit wrap wrapper x".split())
#: Elements whose names say nothing against them.
FREE = frozenset("html body main article".split())
#: An element that a start tag ends where it is still open.
ENDS = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pages a class needs; pages that a text needs whose element is not in its class.
SUPPORT, SUPPORT_ALONE = 3, 10
#: Texts of a class that are more than this share of their pages are an article with copies and no template.
SHARE = 0.5
#: Templates of all hosts that are sent to every task at most; larger ones meet the pages by a shuffle in SALTS parts a host.
TEMPLATE_BYTES, SALTS = 16 << 20, 32


# ---- pages


def _furniture(name: str, tag: str, within: list[str]) -> bool:
    """Whether an element is no part of an article: by its name, or by the last word of its class, id or role."""
    if name in FURNITURE or (name == "header" and "article" not in within and "main" not in within):
        return True
    if name in FREE or "=" not in tag:
        return False
    for m in _named.finditer(tag):
        for called in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in re.split(r"[^a-z]+", called) if w]
            while len(words) > 1 and words[-1] in ENDINGS:
                words.pop()
            if words and words[-1] in FURNITURE_WORDS and not (name == "header" and words[-1] == "header"):
                return True
    return False


def blocks(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[str, int]]]:
    """The page's blocks (path, text, place) and elements (path, place) in order, furniture left out.

    Text between start and end tags of BLOCK is a block; other tags don't end one, and br is white space. A header inside
    article or main is the article's own: its headings stay, all else in it goes. A quote that is not closed ends with its tag.
    """
    stack: list[tuple[str, str, bool]] = []  # element, path, whether text counts
    out, elements, held, place = [], [], [], 0

    def end() -> None:
        nonlocal place
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                place += 1
                out.append((stack[-1][1] if stack else "", text, place))

    def close(n: int) -> None:
        end()
        del stack[n:]

    for m in _token.finditer(page):
        t = m.group()
        if t[0] != "<" or t == "<":
            if not stack or stack[-1][2]:
                held.append(t)
            continue
        tag = _tag.match(t)
        if not tag or m.group(1):
            continue
        name = tag.group(2).lower()
        if name not in BLOCK:
            if tag.group(1):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i]
                        break
                    if stack[i][0] in BLOCK:
                        break
            elif name == "br":
                held.append("\n")
            elif name not in VOID:
                stack.append((name, stack[-1][1] if stack else "", (not stack or stack[-1][2]) and not _furniture(name, t, [])))
            continue
        end()
        if tag.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID:
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in ENDS.get(name, ()) or (stack[i][0] == "p" and name in ENDS_P):
                close(i)
                break
            if stack[i][0] in BLOCK and stack[i][0] != "p":
                break
        within = [s[0] for s in stack]
        words = sorted({w for x in _named.finditer(t) for w in re.split(r"[^a-z]+", (x[2] or x[3] or x[4] or "").lower()) if w}) if "=" in t else []
        path = f"{stack[-1][1] if stack else ''}/{'.'.join([name, *words])}"
        counts = (not stack or stack[-1][2] or (stack[-1][0] == "header" and name in HEADINGS)) and not _furniture(name, t, within)
        if counts:
            place += 1
            elements.append((path, place))
        stack.append((name, path, counts and name != "header"))
    end()
    return out, elements


def _long(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def voice(texts: list[str]) -> int:
    """The least hash of the page's five-word shingles: near copies mostly have it in common, so that they count as one page."""
    h = _hashes([w.encode("utf-8", "surrogatepass") for t in texts for w in t.lower().split()], 5)
    return int(h.min()) - (1 << 63) if len(h) else 0


_TOKEN = "struct<token:long,path:long,text:boolean,at:array<int>,chars:int>"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks (token, text), tokens (of elements and texts, with their places and characters), chars, voice of every page.

    A token is an element at its path, or a text at its path; equal ones share a hash.
    """
    kinds = f"page_id long, url string, blocks array<struct<token:long,text:string>>, tokens array<{_TOKEN}>, chars long, voice long"
    token = pa.struct([("token", pa.int64()), ("path", pa.int64()), ("text", pa.bool_()), ("at", pa.list_(pa.int32())), ("chars", pa.int32())])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("blocks", pa.list_(pa.struct([("token", pa.int64()), ("text", pa.string())]))), ("tokens", pa.list_(token)), ("chars", pa.int64()), ("voice", pa.int64())])

    def row(page_id, url, page: str) -> dict:
        found, elements = blocks(page)
        tokens: dict[int, dict] = {}
        for path, at in elements:
            p = _long(path)
            tokens.setdefault(p, {"token": p, "path": p, "text": False, "at": [], "chars": 0})["at"].append(at)
        named = []
        for path, text, at in found:
            key = _long(f"{path}\n{text}")
            tokens.setdefault(key, {"token": key, "path": _long(path), "text": True, "at": [], "chars": 0})["at"].append(at)
            tokens[key]["chars"] += len(text)
            named.append({"token": key, "text": text})
        return {"page_id": page_id, "url": url, "blocks": named, "tokens": list(tokens.values()), "chars": sum(len(t) for _, t, _ in found), "voice": voice([t for _, t, _ in found])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i in range(b.num_rows):
                rows.append(row(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py() or ""))
                held += rows[-1]["chars"] + 40 * len(rows[-1]["tokens"])
                if held > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    p = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, kinds).withColumn("_url", F.coalesce("url", F.lit("")))
    return p.withColumn("host", host_and_path(F.col("_url"))[0]).drop("_url")


# ---- templates


def classes(voters: DataFrame) -> DataFrame:
    """host, class, token, path, text, alone, support, share: the equivalence classes of at least two tokens, one an element, on SUPPORT pages.

    Tokens of a host are one class if they occur equally often on each of its pages. The vector of these counts is
    kept as 128 bits, a sum over pages, so that it needs no list of pages and is combined before it is shuffled. ``alone``: the text's
    element is in another class, as it occurs on other pages or with other texts too.
    """
    t = voters.select("host", "voice", "chars", F.explode("tokens").alias("t")).select("host", "voice", "chars", "t.token", "t.path", "t.text", F.size("t.at").alias("n"), F.col("t.chars").alias("own"))
    seen = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "voice", "n"))
    t = t.groupBy("host", "token").agg(F.first("path").alias("path"), F.first("text").alias("text"), F.count("*").alias("support"), seen(1).alias("v"), seen(2).alias("w"), F.sum("own").alias("own"), F.sum("chars").alias("all_"))
    c = Window.partitionBy("host", "support", "v", "w")
    t = t.where(F.col("support") >= SUPPORT).withColumns({"share": F.sum("own").over(c) / F.max("all_").over(c), "size": F.count("*").over(c), "elements": F.count_if(~F.col("text")).over(c)})
    t = t.withColumn("alone", F.count_if(~F.col("text")).over(Window.partitionBy("host", "support", "v", "w", "path")) == 0)
    return t.where("size >= 2 AND elements >= 1").select("host", F.xxhash64("host", "support", "v", "w").alias("class"), "token", "path", "text", "alone", "support", "share")


def _met(p: DataFrame, t: DataFrame, keys: list[str]) -> DataFrame:
    """``p`` with the rows of ``t`` (any number a host, small) of its keys, host among them; left join. Hot hosts are dealt in SALTS parts."""
    if bounded(t, TEMPLATE_BYTES, 100):
        return p.join(F.broadcast(t), keys, "left")
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return p.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(t, [*keys, "salt"], "left").drop("salt")


def valid(voters: DataFrame, c: DataFrame) -> DataFrame:
    """host, class of the classes that are ordered and nested on every page.

    Ordered: the tokens come in one order on all pages, and where they repeat, the whole class repeats in that order. Nested: no
    token of the host's first class (that of most pages, then of most tokens) stands within a run of the class, which is in
    the same slot of that class on all pages where it occurs once.
    """
    t = voters.select("host", "voice", F.explode("tokens").alias("t")).select("host", "voice", F.col("t.token").alias("token"), F.explode("t.at").alias("at"))
    x = _met(t, c.select("host", "token", "class"), ["host", "token"]).where("class is not null")
    runs = x.groupBy("host", "voice", "class").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("s"))
    size = c.groupBy("host", "class").agg(F.count("*").cast("int").alias("size"), F.max("support").alias("support"))
    first = size.withColumn("rk", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("support"), F.desc("size"), "class"))).where("rk = 1").select("host", F.col("class").alias("first"))
    runs = _met(runs, size.join(first, "host").select("host", "class", "size", "first"), ["host", "class"])
    roots = runs.where("class = first").select("host", "voice", F.transform("s", lambda e: e["at"]).alias("root"))
    runs = runs.join(roots, ["host", "voice"], "left")
    tokens = F.transform("s", lambda e: e["token"])
    cycle = F.forall(F.transform("s", lambda e, i: F.get(F.col("s"), i % F.col("size"))["token"] == e["token"]), lambda ok: ok)
    begin = lambda k: F.get(F.col("s"), k * F.col("size"))["at"]
    stop = lambda k: F.get(F.col("s"), (k + 1) * F.col("size") - 1)["at"]
    turns = F.sequence(F.lit(0), (F.size("s") / F.col("size")).cast("int") - 1)
    clear = F.forall(turns, lambda k: ~F.exists(F.coalesce("root", F.array().cast("array<int>")), lambda a: (a > begin(k)) & (a < stop(k))))
    slot = F.size(F.filter(F.coalesce("root", F.array().cast("array<int>")), lambda a: a < F.get(F.col("s"), F.lit(0))["at"]))
    runs = runs.select("host", "class", cycle.alias("cycle"), ((F.col("class") == F.col("first")) | clear).alias("clear"), F.xxhash64(F.slice(tokens, 1, F.col("size"))).alias("order"), F.when(F.size("s") == F.col("size"), slot).alias("slot"), (F.col("class") == F.col("first")).alias("is_first"))
    g = runs.groupBy("host", "class").agg(F.every("cycle").alias("cycle"), F.every("clear").alias("clear"), (F.min("order") == F.max("order")).alias("ordered"), (F.coalesce(F.min("slot") == F.max("slot"), F.lit(True)) | F.every("is_first")).alias("placed"))
    return g.where("cycle AND clear AND ordered AND placed").select("host", "class")


def templates(pages: DataFrame) -> DataFrame:
    """host, fixed: the texts (tokens) of each host's template.

    A page votes if no near copy (by ``voice``) of its host does: copies would make an article look like template. Texts of a valid
    class are template where their element is of the class too, or the class is on SUPPORT_ALONE pages; but not where the
    class's texts are over SHARE of their pages.
    """
    voters = written(pages.groupBy("host", "voice").agg(F.min_by(F.struct("tokens", "chars"), F.xxhash64("tokens")).alias("p")).select("host", "voice", "p.tokens", "p.chars"), "voters")
    c = written(classes(voters), "classes")
    texts = c.where(F.col("text") & (F.col("share") <= SHARE) & (~F.col("alone") | (F.col("support") >= SUPPORT_ALONE)))
    wanted = c.join(texts.select("host", "class").distinct(), ["host", "class"], "left_semi")
    top = c.join(texts.select("host").distinct(), "host", "left_semi")  # the first class of hosts with texts must be there to nest in
    return texts.join(valid(voters, top), ["host", "class"]).join(wanted.select("host", "class").distinct(), ["host", "class"], "left_semi").groupBy("host").agg(F.collect_set("token").alias("fixed"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: what fills the slots of its host's template, joined by line ends.

    A text block is left out if the template has it, or if it is in furniture (menus, forms, adverts, comments and the like, by
    element, class, id and role); nothing else is, and hosts of few pages have no template. Text that changes from page to page in an
    advert of unknown name is data to this method. Null html is an empty page; no text is an empty string; a null url is the
    empty host. Rows are kept as they are, repeated or not; an empty table gives none; other columns are not read.
    """
    p = written(parsed(pages), "parsed")
    t = written(templates(p), "templates")
    p = p.select("page_id", "url", "host", "blocks")
    if t.agg(F.coalesce(F.sum(F.size("fixed")), F.lit(0))).first()[0] * 8 > TEMPLATE_BYTES:
        t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(t, ["host", "salt"], "left")
    else:
        p = p.join(F.broadcast(t) if bounded(t, TEMPLATE_BYTES, 100) else t, "host", "left")
    return p.select("page_id", "url", _text().alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _text() -> Column:
    body = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("fixed", b["token"]), F.lit(False)))
    return F.array_join(F.transform(body, lambda b: b["text"]), "\n")
