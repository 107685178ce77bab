"""Class and method names from source code, by indentation, by braces or by ``end``.

Strings, comments and templates are blanked first, by one pass of an alternation that takes whichever
begins first, so nothing in them is read as code. What is left is reduced to the tokens that
matter, declarations and the ends of scopes, and a fold with a stack of scopes goes over these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import detect_language
from ..functions.rows import explode_computed

_SYMBOL = "struct<class_name:string,method_name:string>"
_TOKENS = "array<struct<kind:int,at:int,name:string,of:string,opens:boolean>>"
#: What a token does. The folds hold places of tokens and not their names, since each step copies what it holds.
OVER, OPEN, CLOSE, CLASS, BARE, DEF, MEMBER = range(7)

NAME = r"([#\p{L}_$][\p{L}\p{N}_$]*+)"


def _quoted(quote: str, inside: str = r"[^\n]") -> str:
    """From a quote to the next one that an even number of backslashes stands before."""
    return rf"{quote}{inside}*?(?<!\\)(?:\\\\)*+{quote}"


# What is blanked. The longer beginnings come first.
_ANY = r"[\s\S]"
_LINE, _BLOCK = r"//[^\n]*", rf"/\*{_ANY}*?(?:\*/|\z)"
_HASH = r"#[^\n]*"
_TRIPLE = rf'"""{_ANY}*?(?:"""|\z)'
_CHAR = r"'(?:\\[^\n']{1,9}|[^\\'\n]|\\')'"
_STRING, _APOSTROPHE = _quoted('"'), _quoted("'")
_LEXED = {
    "python": "|".join([rf'"""{_ANY}*?(?<!\\)(?:\\\\)*+"""', rf"'''{_ANY}*?(?<!\\)(?:\\\\)*+'''", _STRING, _APOSTROPHE, _HASH]),
    "script": "|".join([_LINE, _BLOCK, _quoted("`", _ANY), _STRING, _APOSTROPHE]),
    "java": "|".join([_LINE, _BLOCK, _TRIPLE, rf'@"(?:[^"]|"")*+"', _STRING, _CHAR]),
    "go": "|".join([_LINE, _BLOCK, r"`[^`]*`", _STRING, _CHAR]),
    "php": "|".join([_LINE, _BLOCK, _HASH, _quoted('"', _ANY), _quoted("'", _ANY)]),
    "hash": "|".join([r"(?m:^)=begin\b[\s\S]*?(?m:^)=end\b", _HASH, _STRING, _APOSTROPHE]),
}
# What they begin with, so that one look at most characters is enough.
_BEGINS = {"python": "\"'#", "script": "/`\"'", "java": "/@\"'", "go": "/`\"'", "php": "/#\"'", "hash": "=#\"'"}
LEXERS = {name: f"(?=[{_BEGINS[name]}])(?:{pattern})" for name, pattern in _LEXED.items()}

# Declarations of the languages.
_PARAMETERS = r"\([^(){};]*+(?:\([^(){};]*+\)[^(){};]*+)*+\)"
_CONTROL = "if|for|foreach|while|switch|catch|function|return|new|else|do|try|with|super|using|lock|synchronized|fixed|when"
_MEMBER = rf"(?<![\p{{L}}\p{{N}}_$.#])(?={NAME[1:-1]}\s*[<(])(?<!\bnew\s)(?!(?:{_CONTROL})\b){NAME}\s*(?:<[^<>(){{}};]*+>)?\s*{_PARAMETERS}"


_NEVER = r"(?!)"


@dataclass(frozen=True)
class Syntax:
    """How a language declares things. ``members``: functions are members without a keyword, so only what
    stands in a class body is one. ``bare`` classes are scopes that are no symbols by themselves. A text
    that declares anything has one of ``words``. ``begins``: the characters that declarations and openers begin with."""

    lexer: str
    words: tuple[str, ...]
    begins: str
    classes: str
    functions: str
    bare: str = _NEVER
    members: bool = False
    ends: str = ""  # openers of blocks that ``end`` closes
    over: str = ";"  # what ends a declaration without a body


# A function that is an expression up to the end of its line.
_EXPRESSION = r";|\)\s*(?::[^\n{}()=]*+)?=(?![=>])[^\n{}]*+(?=\n|\z)"

_SCRIPT = Syntax(
    "script", ("class",), r"#\p{L}_$", rf"\bclass\s+(?!extends\b|implements\b){NAME}", _MEMBER + r"\s*(?::[^{};=()]*+)?\s*(?=\{)", members=True
)
SYNTAX = {
    **dict.fromkeys(("javascript", "jsx", "typescript", "tsx"), _SCRIPT),
    "java": Syntax("java", ("class", "interface", "enum", "record"), r"#\p{L}_$", rf"\b(?:class|interface|enum|record)\s+{NAME}", _MEMBER + r"\s*(?:throws\s[^{};()]*+)?(?=\{)", members=True),
    "c#": Syntax(
        "java",
        ("class", "interface", "enum", "struct", "record"),
        r"#\p{L}_$",
        rf"\b(?:class|interface|enum|struct|record)\s+{NAME}",
        _MEMBER + rf"\s*(?:where\s[^{{}};]*+)?(?::\s*(?:base|this)\s*{_PARAMETERS}\s*)?(?=\{{|=>)",
        members=True,
    ),
    "kotlin": Syntax("java", ("class", "interface", "object", "fun"), "cfio", rf"\b(?:class|interface|object)\s+{NAME}", rf"\bfun\s+(?:<[^<>]*+>\s*)?(?:[\p{{L}}\p{{N}}_<>?]+\.)*{NAME}", over=_EXPRESSION),
    "scala": Syntax("java", ("class", "object", "trait", "def"), "cdot", rf"\b(?:class|object|trait)\s+{NAME}", rf"\bdef\s+{NAME}", over=_EXPRESSION),
    "swift": Syntax(
        "java", ("class", "struct", "enum", "protocol", "extension", "actor", "func"), "acefps", rf"\b(?:class|struct|enum|protocol|extension|actor)\s+(?!func\b|var\b|let\b){NAME}", rf"\bfunc\s+{NAME}"
    ),
    "php": Syntax("php", ("class", "interface", "trait", "enum", "function"), "cefit", rf"\b(?:class|interface|trait|enum)\s+(?!extends\b){NAME}", rf"\bfunction\s+&?\s*{NAME}"),
    "go": Syntax("go", ("type", "func"), "ft", rf"\btype\s+{NAME}(?:\[[^\]]*\])?\s+(?:struct|interface)\b", rf"\bfunc\s+(?:\([^()]*\)\s*)?{NAME}"),
    "rust": Syntax(
        "java",
        ("struct", "enum", "trait", "union", "fn"),
        "efistu",
        rf"\b(?:struct|enum|trait|union)\s+{NAME}",
        rf"\bfn\s+{NAME}",
        rf"\bimpl\b\s*(?:<[^{{}};]*?>\s*)?(?:[^{{}};]*?\bfor\s+)?{NAME}",
    ),
    "bash": Syntax("hash", ("function", "("), r" \t#\p{L}_$", _NEVER, rf"(?m:^)[ \t]*(?:function[ \t]+{NAME}|(?!function\b){NAME}[ \t]*\([ \t]*\))"),
    "ruby": Syntax(
        "hash",
        ("class", "def"),
        r" \t=bcdefimpuw",
        rf"(?m:^)[ \t]*class[ \t]+(?:[\p{{L}}\p{{N}}_]+::)*{NAME}",
        rf"(?m:^)[ \t]*(?:private[ \t]+|public[ \t]+|protected[ \t]+)?def[ \t]+(?:self\.)?{NAME}[?!=]?",
        rf"(?m:^)[ \t]*module[ \t]+{NAME}",
        ends=r"(?m:^)[ \t]*(?:if|unless|while|until|for|begin|case|class[ \t]*<<)\b|=[ \t]*(?:if|unless|case|begin)\b|\bdo\b",
    ),
}

# Lines of the language that scopes by indentation that open a block. What is taken of a declaration ends with its name,
# of others the indentation is.
PY_NAME = r"[\p{L}_][\p{L}\p{N}_]*+"
PY_BLOCK = (
    rf"(?m)^([ \t]*+(?:class[ \t]+{PY_NAME}(?=[ \t]*[\[(:])|(?:async[ \t]+)?def[ \t]+{PY_NAME}(?=[ \t]*[\[(])"
    r"|(?=(?:async|if|elif|else|for|while|try|except|finally|with|match|case)\b[^\n]*[:(\[{][ \t]*$)))[^\n]*"
)
PY_WORDS = ("class", "def")
INDENTED = ("python", "cython")


def blanked(content: Column, lexer: str) -> Column:
    """The text with every string, comment and template replaced by a blank."""
    return F.regexp_replace(content, LEXERS[lexer], " ")


def _name(token: Column, pattern: str) -> Column:
    """What the first group of a declaration's name holds; look-arounds behind the token cannot be asked again."""
    return _bound(F.regexp_extract(token, pattern, 1), lambda name: F.when(name != "", name))


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _same(acc: Column) -> tuple[Column, Column]:
    return acc["at"].alias("at"), acc["of"].alias("of")


def _emitted(acc: Column, at: Column, of: Column) -> tuple[Column, Column]:
    """The places of the symbols and of the classes that they are in, after one more; no class is -1."""
    return F.array_append(acc["at"], at).alias("at"), F.array_append(acc["of"], F.coalesce(of, F.lit(-1))).alias("of")


def _symbols(found: Column, acc: Column) -> Column:
    """The symbols at the places that a fold over the tokens has found."""

    def symbol(at: Column, of: Column) -> Column:
        return _bound(F.get(found, at), lambda t: named(t, F.get(found, of)["name"]))

    def named(t: Column, parent: Column) -> Column:
        class_name = F.when(t["kind"] == CLASS, t["name"]).otherwise(F.coalesce(t["of"], parent))
        return F.struct(class_name.alias("class_name"), F.when(t["kind"] >= DEF, t["name"]).alias("method_name"))

    return F.zip_with(acc["at"], acc["of"], symbol)


def _lacks(content: Column, words: tuple[str, ...]) -> Column:
    return ~reduce(lambda one, other: one | other, [content.contains(word) for word in words])


def _tokens(content: Column, syntax: Syntax) -> Column:
    """What declares, opens and closes in a text: ``array<struct<kind, at, name, of, opens>>``.

    ``of`` is a class that a function names itself, and ``opens`` says that a declaration is the beginning of its scope.
    """
    closed_by_end = bool(syntax.ends)
    opener = syntax.ends if closed_by_end else r"\{"
    closer = r"\bend\b" if closed_by_end else r"\}"
    alternatives = (syntax.classes, syntax.functions, syntax.bare, opener, closer, syntax.over)
    token = rf"(?=[{syntax.begins}{{}};)])(?:{'|'.join(x for x in alternatives if x != _NEVER)})"
    starts = lambda pattern: pattern.replace(r"(?m:^)", "^").replace("(?<!", "(?!^)(?<!")
    declares_as = lambda pattern: "^(?:" + pattern.replace(r"(?m:^)[ \t]*", "").replace(r"\b", "", 1) + ")"

    none = F.lit(None).cast("string")

    def fact(kind: int | Column, at: Column, name: Column = none, of: Column = none) -> Column:
        kind = F.lit(kind) if isinstance(kind, int) else kind
        return F.struct(kind.alias("kind"), at.alias("at"), name.alias("name"), of.alias("of"), F.lit(closed_by_end).alias("opens"))

    def facts(t: Column, at: Column) -> Column:
        # Most tokens are no declarations, and of these nothing but the kind is asked for.
        is_opener = (t == "{") if not closed_by_end else t.rlike("^(?:" + starts(syntax.ends) + ")$")
        return (
            F.when(t == ("end" if closed_by_end else "}"), fact(CLOSE, at))
            .when((t == ";") | t.startswith(")"), fact(OVER, at))
            .when(is_opener, fact(OPEN, at))
            .otherwise(_bound(F.trim(t, F.lit(" \t\n")), lambda declared: declaration(t, declared, at)))
        )

    def declaration(t: Column, declared: Column, at: Column) -> Column:
        if syntax.classes == _NEVER:
            return other(t, declared, at)
        class_name = F.regexp_extract(declared, declares_as(syntax.classes), 1)
        return _bound(class_name, lambda name: F.when(name != "", fact(CLASS, at, name)).otherwise(other(t, declared, at)))

    def other(t: Column, declared: Column, at: Column) -> Column:
        function = MEMBER if syntax.members else DEF
        kind = function if syntax.bare == _NEVER else F.when(declared.rlike(declares_as(syntax.bare)), BARE).otherwise(function)
        if syntax.members:
            name = _name(t, NAME + r"\s*(?:<[^<>(){};]*+>)?\s*\(")
        else:
            name = F.coalesce(F.when(t.contains("("), _name(t, NAME + r"[ \t]*\([ \t]*\)\s*$")), _name(t, NAME + r"[?!=]?\s*$"))
        return fact(kind, at, name, receiver(declared))

    def receiver(declared: Column) -> Column:
        found = _name(declared, r"^func\s*\(\s*(?:[\p{L}\p{N}_]+\s+)?\*?\s*([\p{L}\p{N}_]+)")
        return F.when(declared.startswith("func"), found)

    tokens = F.regexp_extract_all(blanked(content, syntax.lexer), F.lit(token), F.lit(0))
    return F.when(~_lacks(content, syntax.words), F.transform(tokens, facts)).when(content.isNotNull(), F.array().cast(_TOKENS))


def _scoped(found: Column) -> Column:
    """Symbols from the tokens of a language with braces or ends, functions not descended into.

    A declaration waits for the brace that opens it, and is over at the next semicolon or closing brace without one.
    Inside of a function scopes are only counted.
    """
    # Of a scope the place of its class, or -1; of what waits for its brace the place; how deep it is in a function.
    nothing = F.lit(None).cast("int")
    zero = F.struct(
        _empty("int").alias("scopes"), nothing.alias("waits"), F.lit(0).alias("depth"), _empty("int").alias("at"), _empty("int").alias("of")
    )

    def state(acc: Column, scopes: Column, waits: Column = nothing, depth: int | Column = 0, emitted=None) -> Column:
        depth = F.lit(depth) if isinstance(depth, int) else depth
        return F.struct(scopes.alias("scopes"), waits.alias("waits"), depth.alias("depth"), *(emitted or _same(acc)))

    def step(acc: Column, t: Column) -> Column:
        change = F.when(t["kind"] == CLOSE, -1).when((t["kind"] == OPEN) | (t["opens"] & (t["kind"] > CLOSE)), 1).otherwise(0)
        inside = state(acc, acc["scopes"], depth=acc["depth"] + change)
        return F.when(acc["depth"] > 0, inside).otherwise(outside(acc, t, acc["scopes"], acc["waits"]))

    def outside(acc: Column, t: Column, scopes: Column, waits: Column) -> Column:
        top = F.when(F.size(scopes) > 0, F.slice(scopes, 1, F.greatest(F.size(scopes) - 1, F.lit(0)))).otherwise(scopes)
        in_function = F.get(found, waits)["kind"] >= DEF
        pushed = F.array_append(scopes, F.coalesce(waits, F.lit(-1)))
        return (
            F.when(t["kind"] == CLOSE, state(acc, top))
            .when(t["kind"] == OPEN, F.when(in_function, state(acc, scopes, depth=1)).otherwise(state(acc, pushed)))
            .when(t["kind"] == OVER, F.when(waits.isNull(), acc).otherwise(state(acc, scopes)))
            .otherwise(declared(acc, t, scopes))
        )

    def declared(acc: Column, t: Column, scopes: Column) -> Column:
        is_function = t["kind"] >= DEF
        in_class = F.coalesce(F.try_element_at(scopes, F.lit(-1)) >= 0, F.lit(False))
        emitted = _emitted(acc, t["at"], F.try_element_at(F.filter(scopes, lambda s: s >= 0), F.lit(-1)))
        entered = state(
            acc,
            F.when(t["opens"] & ~is_function, F.array_append(scopes, t["at"])).otherwise(scopes),
            F.when(~t["opens"], t["at"]),
            F.when(t["opens"] & is_function, 1).otherwise(0),
            tuple(F.when(t["kind"] == BARE, before).otherwise(after).alias(name) for name, before, after in zip(("at", "of"), _same(acc), emitted)),
        )
        return F.when((t["kind"] == MEMBER) & ~in_class, state(acc, scopes)).otherwise(entered)

    return F.aggregate(found, zero, step, lambda acc: _symbols(found, acc))


def _indented(content: Column) -> Column:
    """Symbols of a language with indentation, functions not descended into.

    Each line closes the scopes that are not less indented than itself. Only lines that open
    a block can stand between a scope and a deeper declaration, so the others are left out.
    """

    none = F.lit(None).cast("string")

    def facts(line: Column, at: Column) -> Column:
        return _bound(F.ltrim(line, F.lit(" \t")), lambda text: sorted_out(line, text, at))

    def sorted_out(line: Column, text: Column, at: Column) -> Column:
        name = F.substring_index(F.translate(text, "\t", " "), " ", -1)
        return F.struct(
            F.when(text == "", OPEN).when(text.startswith("class"), CLASS).otherwise(DEF).alias("kind"),
            at.alias("at"),
            F.when(text != "", name).alias("name"),
            none.alias("of"),
            (F.char_length(line) - F.char_length(text)).alias("ind"),
        )

    # The places of the open classes, and the indentation of the function that the lines are in, or null.
    nothing = F.lit(None).cast("int")
    zero = F.struct(_empty("int").alias("classes"), nothing.alias("inside"), _empty("int").alias("at"), _empty("int").alias("of"))

    def fold(found: Column) -> Column:
        def step(acc: Column, l: Column) -> Column:
            return F.when(l["ind"] > acc["inside"], acc).otherwise(outside(acc, l))

        def outside(acc: Column, l: Column) -> Column:
            kept = F.filter(acc["classes"], lambda c: F.get(found, c)["ind"] < l["ind"])
            state = lambda classes, inside, emitted: F.struct(classes.alias("classes"), inside.alias("inside"), *emitted)
            emitted = _emitted(acc, l["at"], F.try_element_at(kept, F.lit(-1)))
            return (
                F.when(l["kind"] == CLASS, state(F.array_append(kept, l["at"]), nothing, emitted))
                .when(l["kind"] == DEF, state(kept, l["ind"], emitted))
                .otherwise(state(kept, nothing, _same(acc)))
            )

        return F.aggregate(found, zero, step, lambda acc: _symbols(found, acc))

    lines = F.regexp_extract_all(blanked(content, "python"), F.lit(PY_BLOCK), F.lit(1))
    return F.when(_lacks(content, PY_WORDS), _empty(_SYMBOL)).otherwise(_bound(F.transform(lines, facts), fold))


def symbol_array(content: Column, language: Column) -> Column:
    """``array<struct<class_name, method_name>>``; empty for languages without a known syntax."""
    grouped: dict[Syntax, list[str]] = {}
    for name, syntax in SYNTAX.items():
        grouped.setdefault(syntax, []).append(name)
    tokens = reduce(lambda c, item: c.when(language.isin(*item[1]), _tokens(content, item[0])), grouped.items(), F)
    return (
        F.when(language.isin(*INDENTED), _indented(content))
        .when(language.isin(*SYNTAX), _bound(tokens, _scoped))
        .otherwise(_empty(_SYMBOL))
    )


def extract_symbols(files: DataFrame) -> DataFrame:
    """One row per class ``(class_name, null)`` and per method ``(class or null, method_name)``.

    Languages whose functions have no keyword (Java, C#, the JavaScript family) give the members of classes only.
    """
    # Other languages give empty arrays; a filter would be moved to where the paths come from, and look for the language once more.
    code = files.withColumn("_language", detect_language(F.col("file_path")))
    keys = [c for c in ("namespace", "file_path") if c in files.columns]
    return explode_computed(code, keys, symbol_array(F.col("content"), F.col("_language")), "s").select(*keys, "s.*")
