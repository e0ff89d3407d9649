"""Which source files do not parse (problem 5).

A file is cut into chunks behind top-level statements, where nothing before can change how the rest is
read. A chunk is summarised as the lexer state it ends in, the brackets that it leaves unmatched on
either side, and whether its statements follow the local grammar of the language. Such summaries are
associative, so those of a file's chunks are reduced in order wherever they were computed.
"""

from __future__ import annotations

import ast
import io
import json
import re
import sys
import tokenize
import tomllib
import warnings
from collections.abc import Iterator
from typing import NamedTuple

#: Characters of a chunk, at least; what a text is cut into changes no verdict.
CHUNK = 4_096
LANGUAGES = ("python", "javascript", "typescript", "php", "java", "rust")
#: Also judged by ``validity``; ``is_valid`` knows the languages above only.
JUDGED = (*LANGUAGES, "toml")


class Summary(NamedTuple):
    """``low``: bracket levels below the chunk's begin at which a statement can't be a top-level one."""

    end: str
    closers: str
    openers: str
    ok: bool | None
    low: tuple[int, ...]


PAIR = {")": "(", "]": "[", "}": "{"}


def combine(a: Summary, b: Summary) -> Summary:
    """Summary of a chunk and the next one; ``b`` is taken from the state in which ``a`` ends."""
    openers, closers, ok = a.openers, a.closers, a.ok
    rest = b.closers
    while rest and openers:
        if PAIR[rest[0]] != openers[-1]:
            ok = False
        openers, rest = openers[:-1], rest[1:]
    known = ok is False or b.ok is False
    both = False if known else None if ok is None or b.ok is None else True
    low = set(a.low) | {len(a.closers) + k - len(a.openers) for k in b.low if k >= len(a.openers)}
    return Summary(b.end, closers + rest, openers + b.openers, both, tuple(sorted(low)))


def valid(s: Summary) -> bool | None:
    """None: the chunks alone don't tell."""
    if s.closers or s.openers or s.ok is False or 0 in s.low or s.end not in ("code", "outside"):
        return False
    return s.ok


# Reserved and contextual words of the languages.
JS_WORDS = set(
    "async await break case catch class const continue debugger default delete do else export extends false finally for from function get if import in "
    "instanceof let new null of return set static super switch this throw true try typeof var void while with yield as".split()
)
TS_WORDS = JS_WORDS | set(
    "abstract accessor any asserts boolean constructor declare enum global implements infer interface is keyof module namespace never number object out "
    "override private protected public readonly require satisfies string symbol type undefined unique unknown using".split()
)
PHP_WORDS = set(
    "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif "
    "endswitch endwhile enum eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof "
    "interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use "
    "var while xor yield from self parent int string bool float void mixed null true false iterable object".split()
)
JAVA_WORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements "
    "import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws "
    "transient try void volatile while true false null var record sealed permits non yield when".split()
)
RUST_WORDS = set(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct "
    "super trait true type unsafe use where while abstract become box do final macro override priv try typeof unsized virtual yield union macro_rules raw auto".split()
)
WORDS = {"javascript": JS_WORDS, "typescript": TS_WORDS, "php": PHP_WORDS, "java": JAVA_WORDS, "rust": RUST_WORDS}
JAVA_TOP = set("package import class interface enum record public private protected abstract final static sealed non strictfp module open @ ;".split())
RUST_TOP = set("use pub fn mod struct enum impl trait const static type extern unsafe async macro_rules union # ; auto default".split())
PAREN_WORDS = {
    "javascript": {"if", "while", "switch", "with"}, "typescript": {"if", "while", "switch", "with"}, "php": {"if", "elseif", "while", "for", "foreach", "switch", "match"},
    "java": {"if", "while", "switch", "for"}, "rust": set(),
}
DANGLING = set("= += -= *= /= == === != !== && || ?? => + - % ^ <= >= **".split())
#: Behind these a script goes on.
UNFINISHED = DANGLING | set(". ?. , => ?: const import export function class typeof new extends".split())

#: Signs that only stand between two operands, and signs behind which an operand must come.
BETWEEN = set("% == === != !== && || ?? = += -= *= /= %= <= >= ** * =>".split())
BEFORE = set("= += -= *= /= %= == === != !== && || ?? + - % <= ** / *".split())
#: In Rust these also stand before an operand; in PHP the sign of references does.
ALSO_BEFORE = {"rust": {"*", "&&", "||", "**"}, "php": set(), "java": set(), "javascript": set(), "typescript": set()}
#: Words that need an operand behind them, and words that can't be one.
NEED = {"javascript": {"return", "throw", "case", "typeof", "new", "delete", "void", "instanceof"}, "php": {"throw", "new", "instanceof", "return", "case", "clone"}, "java": {"return", "throw", "new", "instanceof", "case"}, "rust": set()}
NEED["typescript"] = NEED["javascript"] - {"void"}
NO_OPERAND = {"javascript": set("return throw if for while var const let break continue else case catch finally try switch".split()), "php": set("return if for foreach while echo else elseif break continue case catch finally try".split()), "java": set("return throw if for while break continue else case catch finally try".split()), "rust": set()}
NO_OPERAND["typescript"] = NO_OPERAND["javascript"]
#: Words that can't end a list, an argument or a statement.
OPEN_ENDED = {"php": {"as", "instanceof", "insteadof", "extends", "implements", "new"}, "java": {"instanceof", "extends", "implements", "new", "throws"}, "javascript": {"instanceof", "extends", "new", "typeof"}, "rust": {"as", "let", "mod"}}
OPEN_ENDED["typescript"] = OPEN_ENDED["javascript"]
#: Words that a name must follow.
NAMED = {"php": {"trait", "interface"}, "java": {"class", "interface", "enum"}, "rust": {"struct", "enum", "trait", "mod"}, "javascript": set(), "typescript": set()}
RUST_SUFFIX = set("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split()) | {""}
MEMBER = (".", "?.", "->", "::", "?->")
_COLON = re.compile(r"\s*:")
_IMPORTED = re.compile(r"\s*(?:from\b|[,=])")
_BINDING = re.compile(r"\s*[:=,)]")

CONFLICT = r"(?P<conflict>^(?:<{7}|>{7}|={7}|\|{7})(?=[ \r\n]|\Z))"
NUMBER = r"(?P<num>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?P<suffix>\w*))"
OPS = r"(?P<op>\?\?=|\.\.\.|===|!==|\*\*=|<<=|>>>=|=>|->|::|\?->|\?\.|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|\.=|&=|\|=|\^=|\.\.=|\.\.|\*\*|[-+*/%=<>!&|^~?:;,.@#$\\])"
TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^`{}]|\{[^{}]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*`"
WORD = r"(?P<word>[^\W\d]\w*)"


def _lexer(comment: str, strings: str, word: str, open_: str) -> re.Pattern:
    return re.compile(rf"\s*(?:{CONFLICT}|(?P<comment>{comment})|(?P<str>{strings})|{word}|{NUMBER}|(?P<br>[()\[\]{{}}])|(?P<open>{open_})|{OPS}|(?P<bad>\S))", re.M)


LINE_STRINGS = r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\""
JS_LEXER = _lexer(r"//[^\n]*|/\*[\s\S]*?\*/|\A#![^\n]*", LINE_STRINGS + "|" + TEMPLATE, r"(?P<word>[^\W\d][\w$]*|\$[\w$]*|#[^\W\d]\w*)", r"/\*|`")
LEXERS = {
    "javascript": JS_LEXER,
    "typescript": JS_LEXER,
    "php": _lexer(
        r"//(?:[^\n?]|\?(?!>))*|\#(?!\[)(?:[^\n?]|\?(?!>))*|/\*[\s\S]*?\*/",
        r"<<<[ \t]*(?P<q>['\"]?)(?P<tag>\w+)(?P=q)\r?\n[\s\S]*?^[ \t]*(?P=tag)\b|'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`|(?P<close>\?>)",
        r"(?P<var>\$+[^\W\d]\w*)|(?P<word>\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*)", r"/\*|['\"`]|<<<",
    ),
    "java": _lexer(r"//[^\n]*|/\*[\s\S]*?\*/", r'"""[\s\S]*?(?<!\\)"""|"(?!"")(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\[^\n]+?)'", r"(?P<word>[^\W\d][\w$]*|\$[\w$]*)", r'/\*|"""'),
    "rust": _lexer(
        r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/",
        r"(?:br|cr|r)(?P<h>#+)\"[\s\S]*?\"(?P=h)|(?:br|cr|r)\"[^\"]*\"|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'|(?P<life>'[^\W\d]\w*(?!'))",
        r"(?P<word>(?:r\#)?[^\W\d]\w*)", r"/\*|[bcr]?\#*\"",
    ),
}
#: Words behind which a slash begins a regular expression.
BEFORE_REGEX = ("return", "typeof", "case", "in", "of", "delete", "void", "throw")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: How a state that can span lines ends.
ENDS = {"comment": re.compile(r"\*/"), "`": re.compile(r"(?:[^`\\]|\\[\s\S])*?`"), "'": re.compile(r"(?:[^'\\]|\\[\s\S])*?'"), '"': re.compile(r'(?:[^"\\]|\\[\s\S])*?"'), '"""': re.compile(r'[\s\S]*?(?<!\\)"""')}
TAG = re.compile(r"<\?(?:php\b|=)", re.I)


def begin(language: str) -> str:
    return "outside" if language == "php" else "code"


def summarize(text: str, language: str, state: str) -> Summary:
    """Summary of one chunk that begins in ``state``."""
    if language == "python":
        return _python(text)
    if language == "toml":
        return Summary("code", "", "", _toml(text), ())
    pos = 0
    if state not in ("code", "outside"):
        m = ENDS[state].match(text) if state != "comment" else ENDS[state].search(text)
        if not m:
            return Summary(state, "", "", True, ())
        pos, state = m.end(), "code"
    return _Local(text, language).run(pos, state)


class _Local:
    """Lexes a chunk and checks its statements by the local grammar of the language."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.stack: list[tuple[str, bool, str]] = []  # bracket, whether it opened a macro's tokens, what kind of braces
        self.closers: list[str] = []
        self.low: set[int] = set()

    def run(self, pos: int, state: str) -> Summary:
        text, language, ok = self.text, self.language, True
        while True:
            if state == "outside":
                m = TAG.search(text, pos)
                if not m:
                    return self.summary("outside", ok)
                pos, state = m.end(), "code"
            pos, state, good = self.code(pos)
            ok = ok and good
            if state != "outside" or not good:
                return self.summary(state, ok)

    def summary(self, end: str, ok: bool) -> Summary:
        return Summary(end, "".join(self.closers), "".join(b for b, _, _ in self.stack), ok, tuple(sorted(self.low)))

    def code(self, pos: int) -> tuple[int, str, bool]:
        text, language = self.text, self.language
        match, words, parens = LEXERS[language].match, WORDS[language], PAREN_WORDS[language]
        script, java, rust, php = language in ("javascript", "typescript"), language == "java", language == "rust", language == "php"
        plain_js = language == "javascript"
        stack, closers = self.stack, self.closers
        prev, prev_kind, prev2, row = "", "", "", 0  # row: words in a row
        fresh = not php  # a statement may begin here
        header = ""  # word that names the kind of the next braces
        last, annotated = pos, 0  # end of the last token; how much of "): type" has been read
        between, also, need, no_operand, open_ended, named = BETWEEN, ALSO_BEFORE[language], NEED[language], NO_OPERAND[language], OPEN_ENDED[language], NAMED[language]
        loops: list[list[int]] = []  # of each open "for (": brackets below it, its semicolons
        n = len(text)
        while True:
            m = match(text, pos)
            if m is None:
                # chunks but the last end behind whole statements
                return n, "code", bool(stack or closers) or self.complete(prev, prev2)
            kind = m.lastgroup
            if kind == "str":
                if rust and m.group("life"):
                    kind = "life"
                elif php and m.group("close"):
                    kind = "close"
            at, pos = m.start(kind), m.end()
            if kind == "comment":
                continue
            tok = text[at:pos] if kind not in ("str",) else "''"
            macro = bool(stack) and stack[-1][1]
            if kind == "close":
                return pos, "outside", True
            if kind == "conflict" or kind == "bad":
                return pos, "code", False
            if kind == "open":
                opener = tok.lstrip("bcr#") if rust else tok
                if opener == "/*":
                    return n, "comment", True
                if (php or rust) and opener in "'\"`":
                    return n, opener, True
                if tok in ("`", '"""'):
                    return n, tok, True
                return n, "code", False
            if kind == "life":
                kind, tok = "life", "'"
            elif script and tok in ("/", "/=") and (prev_kind in ("op", "", "br_open") or (prev_kind == "word" and prev in BEFORE_REGEX)):
                x = REGEX.match(text, at)
                if x:
                    pos, kind, tok = x.end(), "str", "''"
            if kind == "num" and m.group("suffix") and not (m.group("suffix").strip("_") in RUST_SUFFIX if rust else m.group("suffix") in ("n", "L", "l", "f", "F", "d", "D")) and not macro:
                return pos, "code", False
            if fresh:
                if not stack and tok not in (";", "}"):
                    if java and tok not in JAVA_TOP or rust and tok not in RUST_TOP and not (kind == "word" and text[pos : pos + 1] in ("!", ":")):
                        self.low.add(len(closers))
                fresh = False
            operand = kind in ("str", "num", "var") or (kind == "word" and tok not in words)
            if not macro:
                after = prev_kind in ("str", "num", "var") or (prev_kind == "word" and prev not in words and prev2 not in (".", "?.", "->", "::")) or prev == "]"
                if operand and after:
                    if script:
                        if text.find("\n", last, at) < 0:
                            return pos, "code", False
                    elif php:
                        if not (prev_kind == "word" and kind in ("var",)) and not (prev == "]" and kind == "word"):
                            return pos, "code", False
                    elif java:
                        if kind in ("str", "num") or prev_kind in ("str", "num"):
                            return pos, "code", False
                    elif rust and prev != "]":
                        return pos, "code", False
                row = row + 1 if kind == "word" and tok not in words else 0
                if java and row > 2:
                    return pos, "code", False
                if prev_kind == "word" and prev2 not in (".", "?.", "->", "::"):
                    if prev in parens and tok not in ("(", ":", "=>", ",", ";", ")", "=", "}"):
                        return pos, "code", False
                    if script and prev == "for" and tok not in ("(", "await", ":", ",", ";", "=", "}"):
                        return pos, "code", False
                    if script and prev2 != "as" and not self.script_word(prev, kind, tok, pos, at, plain_js):
                        return pos, "code", False
                    if rust and prev in ("const", "static") and kind == "word" and tok not in words and not _COLON.match(text, pos):
                        return pos, "code", False
                    if not self.follows(prev, prev2, kind, tok, at, last, need, no_operand, open_ended, named):
                        return pos, "code", False
                if plain_js and tok == ":" and prev_kind == "word" and prev2 in ("(", ",") and stack and stack[-1][0] == "(":
                    return pos, "code", False
                if plain_js and tok == "{" and annotated == 3:
                    return pos, "code", False
                if prev in BEFORE and prev_kind == "op" and kind == "op" and tok in between and tok not in also and prev2 not in ("operator", "?"):
                    return pos, "code", False
                if tok == "else" and prev in ("", "{") and (script or java or php) and not _BINDING.match(text, pos):
                    return pos, "code", False
                if prev == ":" and prev_kind == "op" and (script and (tok in (")", "]", ",") or tok == "}" and not (stack and stack[-1][2] == "other")) or rust and tok in ("}", ")", ",")) and prev2 not in ("default", "case"):
                    return pos, "code", False
                if prev in DANGLING and (tok in (")", "]", ";") or tok == "}" and prev != "=>") and not (rust and prev in ("-", "=>", "..")) and not (prev in ("=", "+", "-") and prev2 in ("?", "operator")):
                    return pos, "code", False
                if prev == "(" and tok == ",":
                    return pos, "code", False
                if prev == "." and kind not in ("word", "op", "num") and tok not in ("{", "(", "''") and not php:
                    return pos, "code", False
            if kind == "br":
                if tok in "([{":
                    if tok == "{":
                        block = "init" if prev in ("=", "]", ",", "(", "{", ":", "return", "=>") and not (prev == "{" and not (stack and stack[-1][2] == "init")) else header or "block"
                        header = ""
                    else:
                        block = ""
                    if tok == "(" and not rust and (prev == "for" and prev2 not in MEMBER or prev == "await" and prev2 == "for"):
                        loops.append([len(stack), 0])
                    stack.append((tok, macro or rust and prev == "!" , block))
                    kind = "br_open"
                else:
                    if stack:
                        opener, _, block = stack.pop()
                        if PAIR[tok] != opener:
                            return pos, "code", False
                        if loops and loops[-1][0] == len(stack) and loops.pop()[1] not in (0, 2):
                            return pos, "code", False
                        if java and tok == "}" and block in ("block", "class") and prev not in (";", "}", "{", ""):
                            return pos, "code", False
                    else:
                        closers.append(tok)
                        block = ""
                    if tok == "}" and not stack and not php:
                        fresh = True
                    if tok == "]" and not stack and rust:
                        fresh = prev2 != ""
            elif tok == ";":
                fresh = not stack and not php
                header = ""
                if loops and loops[-1][0] == len(stack) - 1:
                    loops[-1][1] += 1
            elif kind == "word" and tok in ("enum", "switch", "match") or tok == "@interface":
                header = "other"
            elif kind == "word" and tok == "class" and prev not in MEMBER and not _BINDING.match(text, pos):
                header = "class"
            if plain_js:
                if tok == ")":
                    annotated = 1
                elif annotated == 1 and tok == ":":
                    annotated = 2
                else:
                    annotated = 3 if annotated >= 2 and (kind == "word" and (tok not in words or tok == "void") or annotated == 3 and tok in (".", "<", ">", "[", "]", ",")) else 0
            prev2, prev, prev_kind, last = prev, tok, kind, pos

    def complete(self, prev: str, prev2: str) -> bool:
        """Whether a text may end behind ``prev2 prev`` when no bracket is open."""
        if self.language in ("java", "php", "rust"):
            return prev in ("", ";", "}") or self.language == "rust" and prev == "]"
        return prev not in UNFINISHED or prev[0].isalpha() and prev2 in (".", "?.", "as")

    def follows(self, prev: str, prev2: str, kind: str, tok: str, at: int, last: int, need: set, no_operand: set, open_ended: set, named: set) -> bool:
        """Whether ``tok`` may follow the reserved word ``prev``, which is no member's name."""
        if prev in need and kind == "op" and tok in BETWEEN and not (tok == "=" and self.stack and self.stack[-1][2] == "class"):
            return False
        if prev in need and kind == "word" and tok in no_operand and self.text.find("\n", last, at) < 0:
            return False
        if prev in open_ended and tok in (")", ";", "]", ",") and prev2 not in ("const", "function", "case", "{", ",", "(", "as", "fn"):
            return False
        if prev in ("as",) and prev in open_ended and tok in (")", ";", "]"):
            return False
        if prev in named and kind != "word" and tok not in ("(", "=", "?", ":", ",", ")", ";", "}", "|", "&"):
            return False
        return not (self.language == "php" and prev == "class" and tok == "{" and prev2 not in ("new", "readonly"))

    def script_word(self, prev: str, kind: str, tok: str, pos: int, at: int, plain: bool) -> bool:
        """Whether ``tok`` may follow the reserved word ``prev``."""
        if prev in ("const", "let", "var"):
            if kind != "word" and tok not in ("[", "{"):
                return prev != "const" and kind != "str" and kind != "num"
            return not (plain and kind == "word" and _COLON.match(self.text, pos))
        if prev == "import":
            if kind == "word" and tok not in ("type", "defer", "source"):
                return _IMPORTED.match(self.text, pos) is not None
            return kind in ("word", "str", "br", "op")
        if prev == "class":
            return kind == "word" or tok in ("{", ":", ",", "=", ")", ";", "}")
        if prev == "function":
            return kind == "word" or tok in ("(", "*", ":", ",", "=", ")", ";", "}", "?")
        return True


def _python(text: str) -> Summary:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError):
        return Summary("code", "", "", False, ())
    except (RecursionError, MemoryError):
        return Summary("code", "", "", _python_tokens(text), ())
    return Summary("code", "", "", True, ())


def _python_tokens(text: str) -> bool:
    """Whether the tokens and brackets of a text are whole that is nested too deeply for the parser."""
    open_: list[str] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.ERRORTOKEN:
                return False
            if t.type == tokenize.OP and t.string in "([{":
                open_.append(t.string)
            elif t.type == tokenize.OP and t.string in PAIR and (not open_ or open_.pop() != PAIR[t.string]):
                return False
    except (tokenize.TokenError, SyntaxError, ValueError):
        return False
    return not open_


def _toml(text: str) -> bool:
    """By Python's own parser, whose limits on depth and digits are lifted for as long as it runs."""
    depth, digits = sys.getrecursionlimit(), sys.get_int_max_str_digits()
    sys.setrecursionlimit(depth + 4 * (text.count("[") + text.count("{")))
    sys.set_int_max_str_digits(0)
    try:
        tomllib.loads(text.removeprefix("\ufeff"))
    except tomllib.TOMLDecodeError:
        return False
    finally:
        sys.setrecursionlimit(depth)
        sys.set_int_max_str_digits(digits)
    return True


_LINE_ENDS = re.compile(r"[ \t\r]*\n\s*")


def plain_places(text: str, language: str) -> Iterator[int]:
    """Places at line ends, outside all brackets, behind a semicolon or a closing brace, where reading may begin anew.

    Only there no string, comment, template or macro is open, and no rule looks at what is before.
    Where a text can't be lexed the places end.
    """
    match, php, script, pos = LEXERS[language].match, language == "php", language in ("javascript", "typescript"), 0
    stack: list[str] = []
    prev, prev_kind, outside = "", "", php
    while True:
        if outside:
            m = TAG.search(text, pos)
            if not m:
                return
            pos, prev, prev_kind, outside = m.end(), "", "", False
        m = match(text, pos)
        if m is None:
            return
        kind = m.lastgroup
        at, pos = m.start(kind), m.end()
        if kind in ("bad", "conflict", "open"):
            return
        if kind == "comment":
            continue
        if kind == "str":
            outside = php and m.group("close") is not None
            tok = "''"
        else:
            tok = text[at:pos]
        if script and tok in ("/", "/=") and (prev_kind in ("op", "", "br_open") or prev_kind == "word" and prev in BEFORE_REGEX):
            x = REGEX.match(text, at)
            if x:
                pos, kind, tok = x.end(), "str", "''"
        if kind == "br":
            if tok in "([{":
                stack.append(tok)
                kind = "br_open"
            elif not stack or stack.pop() != PAIR[tok]:
                return
        if not stack and (tok == ";" or tok == "}" and language != "java"):
            m = _LINE_ENDS.match(text, pos)
            # behind a brace a slash divides, at the begin of a text it doesn't; so with Rust's lone brackets
            if m and (tok == ";" or text[m.end() : m.end() + 1] not in ("/", "[")):
                yield pos
        prev, prev_kind = tok, kind


def cut_chunks(text: str, language: str, size: int = CHUNK) -> list[str]:
    """Chunks of at least ``size`` characters that end at plain places; a text without such places stays whole.

    Python has no way to tell where a chunk may end without parsing what is before it, so its files
    stay whole.
    """
    if language == "python" or language not in LANGUAGES or len(text) <= size:
        return [text]
    out, pos = [], 0
    for end in plain_places(text, language):
        if end - pos >= size:
            out.append(text[pos:end])
            pos = end
    return [*out, text[pos:]]


def state_map(chunk: str, language: str, first: bool) -> dict[str, Summary]:
    """Chunks but the first begin in code, as they are cut there."""
    state = begin(language) if first else "code"
    return {state: summarize(chunk, language, state)}


def reduce_maps(maps: list[dict[str, Summary]], language: str) -> bool | None:
    """Whether the file of these chunks is valid."""
    total = maps[0][begin(language)]
    for m in maps[1:]:
        if total.end not in m:
            return False
        total = combine(total, m[total.end])
    return valid(total)


def dump(maps: dict[str, Summary]) -> str:
    return json.dumps(maps)


def load(s: str) -> dict[str, Summary]:
    return {k: Summary(v[0], v[1], v[2], v[3], tuple(v[4])) for k, v in json.loads(s).items()}


def is_valid(text: str | None, language: str | None, size: int = CHUNK) -> bool:
    """Null and empty texts and languages without grammar here are valid."""
    if not text or language not in LANGUAGES:
        return True
    chunks = cut_chunks(text, language, size)
    return reduce_maps([state_map(c, language, i == 0) for i, c in enumerate(chunks)], language) is not False


# --- Spark -----------------------------------------------------------------------------------------

_PARTS = "id long, idx int, language string, maps string, chunk string"


def _summaries(batches):
    import pyarrow as pa

    for b in batches:
        ids, idxs, langs, texts = (b.column(i).to_pylist() for i in range(4))
        maps = [dump(state_map(t or "", g, i == 0)) if g in JUDGED and t else None for i, g, t in zip(idxs, langs, texts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(idxs, pa.int32()), pa.array(langs, pa.string()), pa.array(maps, pa.string())], names=["id", "idx", "language", "maps"]
        )


def _chunks(size: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i, g, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                parts = cut_chunks(t, g, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([g] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["id", "idx", "language", "text"]
                )

    return run


def _verdicts(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        for g, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            maps = [load(p["maps"]) for p in parts if p["maps"] is not None]
            out.append(reduce_maps(maps, g) is not False if maps and g in JUDGED else True)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_())], names=["id", "is_valid"])


def validity(files, size: int = CHUNK):
    """``id, is_valid`` of ``id, language, text``, one row for each id (unique).

    Texts up to ``size`` characters are one chunk and stay in their task; longer ones are cut, and
    their chunks, if they have places to cut at, are spread over all tasks. Only the summaries, about a hundred bytes a chunk, are
    brought together by id. TOML stays whole. Null and empty texts, and languages without a grammar or parser here, are valid.
    """
    from pyspark.sql import functions as F

    files = files.select("id", "language", "text")
    long_ = F.coalesce(F.length("text"), F.lit(0)) > size
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = files.where(~long_).select("id", F.lit(0).alias("idx"), "language", "text")
    cut = files.where(long_).mapInArrow(_chunks(size), "id long, idx int, language string, text string").repartition(n, "id", "idx")
    maps = whole.unionByName(cut).mapInArrow(_summaries, "id long, idx int, language string, maps string")
    by_file = maps.groupBy("id").agg(F.first("language").alias("language"), F.array_sort(F.collect_list(F.struct("idx", "maps"))).alias("parts"))
    return by_file.mapInArrow(_verdicts, "id long, is_valid boolean")
