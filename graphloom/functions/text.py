"""Column functions: names, paths, tokens, signatures. All run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def lookup(key: Column, table: dict, default: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def node_id(path: Column, symbol: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit(":"), symbol), 256), 1, 32)


def cache_key(content_hash: Column, operation: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", content_hash, operation, model), 256), 1, 32)


def module_hash(hashes: Column) -> Column:
    """One hash of a module's file hashes, in the order they come in."""
    return F.sha2(F.concat(F.lit("["), F.array_join(hashes, " "), F.lit("]")), 256)


def file_tokens(size: Column) -> Column:
    return (size / F.lit(fixed.BYTES_PER_TOKEN)).cast("int")


def text_tokens(text: Column) -> Column:
    """1.3 for each run without space, punctuation or symbol, truncated, and 1 for each of the latter two."""
    words = F.regexp_count(text, F.lit(r"(?U)[^\s\p{P}\p{S}]+"))
    marks = F.regexp_count(text, F.lit(r"[\p{P}\p{S}]"))
    return F.floor(words * F.lit(fixed.TOKENS_PER_WORD)).cast("int") + marks


def truncated(text: Column, limit: int) -> Column:
    """Struct (text, cut): at most 4 * limit characters, ended at a line, sentence or word if one ends in the second half.

    Lengths are in characters, so no character is split.
    """
    most = 4 * limit
    head = F.substring(text, 1, most)

    def last(mark: str) -> Column:
        at = F.instr(F.reverse(head), mark[::-1])
        return F.when(at > 0, most - at - len(mark) + 1).otherwise(-1)

    line, sentence, word = last("\n"), last(". "), last(" ")
    cut = (
        F.when(line > most // 2, F.concat(F.left(head, line), F.lit("\n... (truncated)")))
        .when(sentence > most // 2, F.concat(F.left(head, sentence + 1), F.lit(" ... (truncated)")))
        .when(word > most // 2, F.concat(F.left(head, word), F.lit(" ... (truncated)")))
        .otherwise(F.concat(head, F.lit("... (truncated)")))
    )
    fits = (text_tokens(text) <= limit) | (F.length(text) <= most)
    return F.when(fits, F.struct(text.alias("text"), F.lit(False).alias("cut"))).otherwise(F.struct(cut.alias("text"), F.lit(True).alias("cut")))


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ext(path: Column) -> Column:
    """From the last dot after the last slash; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"\.[^.]*$", "")


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def package_of(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def language(path: Column) -> Column:
    return lookup(F.lower(ext(path)), fixed.LANGUAGE_OF_EXT)


def source_language(path: Column) -> Column:
    return lookup(F.lower(ext(path)), fixed.SOURCE_LANGUAGE_OF_EXT, "text")


def language_group(lang: Column) -> Column:
    return F.coalesce(lookup(lang, fixed.LANGUAGE_GROUPS), lang)


def is_exported(name: Column, lang: Column) -> Column:
    return F.when(name == "", False).when(lang == "go", name.rlike(r"^\p{Lu}")).when(lang == "python", ~name.startswith("_")).otherwise(True)


def count_params(params: Column) -> Column:
    """-1 for variadic lists; commas inside brackets don't count, and an arrow closes a bracket as well."""
    edges = r"^\s+|\s+$"
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(params, edges, ""), r"(?s)^\((.*)\)$", "$1"), edges, "")
    # Only brackets and commas are walked through, and these where there are brackets.
    marks = F.regexp_replace(inner, r"[^()\[\]{}<>,]+", "")
    commas = F.aggregate(
        F.split(marks, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)).alias("depth"),
            (s["n"] + F.when((c == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("n"),
        ),
        lambda s: s["n"],
    )
    commas = F.when(marks.rlike("^,*$"), F.length(marks)).otherwise(commas)
    return F.when(inner == "", 0).when(inner.contains("...") | inner.contains("*args") | inner.contains("**kwargs"), -1).otherwise(commas + 1)


def count_args(arguments: Column) -> Column:
    """Of the text with its brackets: 0 if blank inside, else commas and one, nested commas too."""
    inner = F.substring(arguments, F.lit(2), F.greatest(F.length(arguments) - 2, F.lit(0)))
    return F.when(F.trim(inner) == "", 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(","))) + 1)


def signature(lang: Column, name: Column, params: Column, receiver: Column, result: Column | None = None) -> Column:
    """A declaration's line; with a result where one is given and not empty: behind the list, or in front of the name in Java and C#."""
    lead = F.when(lang == "go", F.concat(F.lit("func "), F.when(receiver != "", F.concat(receiver, F.lit(" "))).otherwise("")))
    lead = lead.when(lang == "python", F.lit("def ")).when(lang.isin("typescript", "javascript"), F.lit("function ")).when(lang == "rust", F.lit("fn ")).otherwise("")
    if result is None:
        return F.concat(lead, name, params)
    first = F.when(lang.isin("java", "c_sharp") & (result != ""), F.concat(result, F.lit(" "))).otherwise("")
    mark = F.when(lang == "go", " ").when(lang.isin("python", "rust"), " -> ").when(lang.isin("typescript", "javascript"), ": ")
    return F.concat(lead, first, name, params, F.when((result != "") & mark.isNotNull(), F.concat(mark, result)).otherwise(""))


def field_names(block: Column) -> Column:
    first = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(F.split(F.trim(x), r"\s+")[0], "[:,]+$", ""))
    return F.filter(first, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#") & ~x.startswith("/*"))


def receiver_type(receiver: Column) -> Column:
    """The last word inside the brackets, without one star."""
    last = F.element_at(F.split(F.trim(F.regexp_replace(receiver, r"^[()]+|[()]+$", "")), r"\s+"), -1)
    return F.regexp_replace(last, r"^\*", "")


def normal_import(name: Column) -> Column:
    """The last part of an import: after slashes, then after dots unless one leads, without a code extension, lower case."""
    last = F.substring_index(F.regexp_replace(name, "^[\"']+|[\"']+$", ""), "/", -1)
    last = F.when(last.contains(".") & ~last.startswith("."), F.substring_index(last, ".", -1)).otherwise(last)
    return F.lower(F.regexp_replace(last, r"\.(py|go|js|ts|jsx|tsx|rb|rs|c|h|cpp|hpp|java|swift)$", ""))


def is_stdlib(name: Column) -> Column:
    return name.isin(*fixed.STDLIB_NAMES)


def import_base(name: Column) -> Column:
    return stem(name)


def dependency_name(name: Column) -> Column:
    """The shown name of an external dependency: its last path part, or the one before a version part."""
    parts = F.split(name, "/")
    last, before = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    return F.when(last.rlike(r"^v\d+$") & before.isNotNull(), before).otherwise(last)


def system_name(path: Column) -> Column:
    """Of a directory: its first part that means something, with spaces and capital initials."""
    parts = F.split(path, "/")
    meaning = F.filter(parts, lambda p: ~F.lower(p).isin(*fixed.SYSTEM_SKIPPED))
    picked = F.coalesce(F.replace(F.replace(F.try_element_at(meaning, F.lit(1)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")), F.element_at(parts, -1))
    return F.array_join(F.transform(F.split(picked, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def one_decimal(x: Column) -> Column:
    """x with one decimal; exact ties go to the even digit."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def human_size(size: Column) -> Column:
    out = F.concat(one_decimal(size / 1024.0**4), F.lit("TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024.0 ** (power + 1), F.concat(one_decimal(size / 1024.0**power), F.lit(unit))).otherwise(out)
    return out


def human_tokens(tokens: Column) -> Column:
    return F.when(tokens < 1000, tokens.cast("string")).otherwise(F.concat(one_decimal(tokens / 1000.0), F.lit("k")))


def node_text(kind: Column, name: Column, sign: Column, doc: Column, path: Column) -> Column:
    """What is embedded for a node; empty parts are left out and long descriptions cut at 500."""
    kinds = F.element_at(F.array(*map(F.lit, fixed.NODE_KINDS)), kind + 1)
    short = F.when(F.length(doc) > 500, F.concat(F.substring(doc, 1, 500), F.lit("..."))).otherwise(doc)
    return F.concat_ws("\n", F.when(name != "", F.concat(kinds, F.lit(": "), name)), F.when(sign != "", F.concat(F.lit("Signature: "), sign)), F.when(doc != "", F.concat(F.lit("Description: "), short)), F.when(path != "", F.concat(F.lit("Location: "), path)))


def with_code(text: Column, lang: Column, source: Column) -> Column:
    """What is embedded for a node with its source, which is cut at 1000 characters; the text alone without one."""
    cut = F.when(F.length(source) > 1000, F.concat(F.substring(source, 1, 1000), F.lit("\n// ... truncated"))).otherwise(source)
    return F.coalesce(F.concat(text, F.lit("\n\nCode:\n```"), lang, F.lit("\n"), cut, F.lit("\n```")), text)


def snippet(source: Column) -> Column:
    """The first 500 characters of a hit's source."""
    return F.when(F.length(source) > 500, F.concat(F.substring(source, 1, 500), F.lit("\n// ..."))).otherwise(source)


def mock_embedding(text: Column, size: int = fixed.EMBEDDING_SIZE) -> Column:
    """The deterministic test embedding: ((A + (i + 1) B) mod 1000) / 1000, B the sum of code points, A that of code point times byte offset."""
    sums = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("at")),
        lambda s, c: F.struct((s["a"] + F.ascii(c) * s["at"]).alias("a"), (s["b"] + F.ascii(c)).alias("b"), (s["at"] + F.octet_length(c)).alias("at")),
    )
    # The sums are bound to a variable, so they are worked out once for a text.
    return F.transform(F.array(sums), lambda s: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((s["a"] + i * s["b"]) % 1000) / 1000.0))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def match_score(name: Column, sign: Column, doc: Column, path: Column, query: str, fuzzy: bool = True) -> Column:
    """Struct (score, reason) of a name search; score 0 is no match."""
    query = query.lower()
    words, low = query.split(), F.lower(name)

    def hit(score: Column, reason: str) -> Column:
        return F.struct(score.alias("score"), F.lit(reason).alias("reason"))

    out = F.when(low == query, hit(F.lit(1.0), "exact"))
    out = out.when(low.startswith(query), hit(F.lit(0.9), "prefix"))
    if fuzzy:
        out = out.when(low.contains(query), hit(F.lit(0.7), "contains"))
        if len(words) > 1:
            hits = sum((F.lower(F.coalesce(c, F.lit(""))).contains(w).cast("int") for w in words for c in (name, sign, doc)), F.lit(0))
            part = hits * F.lit(0.5) / F.lit(3.0 * len(words))
            out = out.when(part > 0.1, hit(part, "words"))
        out = out.when(F.lower(path).contains(query), hit(F.lit(0.4), "path"))
    return out.otherwise(hit(F.lit(0.0), ""))


def function_json(name: Column, sign: Column, receiver: Column, exported: Column, line: Column) -> Column:
    """A bare string if there is only a name, else an object; empty parts are left out."""
    plain = (sign == "") & (receiver == "") & ~exported & (line == 0)
    parts = F.struct(name.alias("name"), F.nullif(sign, F.lit("")).alias("signature"), F.nullif(receiver, F.lit("")).alias("receiver"), F.when(exported, True).alias("is_exported"), F.nullif(line, F.lit(0)).alias("line"))
    return F.when(plain, F.concat(F.lit('"'), F.regexp_replace(name, r'(["\\\\])', r"\\$1"), F.lit('"'))).otherwise(F.to_json(parts))


def function_name(json: Column) -> Column:
    """The name in either form."""
    return F.coalesce(F.get_json_object(json, "$.name"), F.from_json(F.concat(F.lit('{"name":'), json, F.lit("}")), "name string")["name"])
