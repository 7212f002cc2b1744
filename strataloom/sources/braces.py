"""Symbols and edges of languages with braces: one lexer, one walk over blocks, and a table of forms by language.

No grammar is installed for these, so declarations are told by their leading words and by where they stand: a block belongs
to the declaration whose head it follows, and a name before a parenthesis is a call unless a declaration's head says
otherwise. What this cannot see is what macros and templates expand to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LEXER = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<raw>r\#*"(?:.*?)"\#*|R"\((?:.*?)\)")|(?P<string>"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])+'(?!\w))|(?P<number>\d[\w.]*)|(?P<name>[@$\#]?[A-Za-z_]\w*)|(?P<mark>=>|->|::|\?\.|[^\s\w])""",
    re.S,
)


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass(frozen=True)
class Forms:
    """What a language calls things."""

    types: dict[str, str]
    functions: frozenset[str] = frozenset()
    methods: bool = False  # a name, parentheses and a block inside a type are a method
    free: bool = False  # the same outside of any type is a function
    imports: frozenset[str] = frozenset({"import"})
    blocks: frozenset[str] = frozenset()  # words that open a block of another declared name


# Words that are no names of functions.
KEYWORDS = frozenset(
    "if else for foreach while do switch case match return new throw try catch finally with function func fn class struct enum interface trait union impl import use using package namespace "
    "sizeof typeof instanceof await async yield in of is as not and or lock fixed checked unchecked select go defer range super this self delete void unsafe loop move elseif echo print isset unset array list "
    "synchronized assert static_cast dynamic_cast reinterpret_cast const_cast decltype alignof noexcept operator template catch require include extends implements where".split()
)
TYPES = {"class": "class", "interface": "interface", "enum": "enum"}
LANGUAGES: dict[str, Forms] = {
    "rust": Forms({"struct": "struct", "enum": "enum", "trait": "trait", "union": "struct"}, frozenset({"fn"}), imports=frozenset({"use"}), blocks=frozenset({"impl"})),
    "go": Forms({"type": "struct"}, frozenset({"func"})),
    "typescript": Forms(TYPES, frozenset({"function"}), methods=True),
    "javascript": Forms({"class": "class"}, frozenset({"function"}), methods=True),
    "java": Forms({**TYPES, "record": "class"}, methods=True),
    "csharp": Forms({**TYPES, "struct": "struct", "record": "class"}, methods=True, imports=frozenset({"using"})),
    "cpp": Forms({"class": "class", "struct": "struct", "enum": "enum", "union": "struct"}, methods=True, free=True, imports=frozenset({"#include"})),
    "php": Forms({**TYPES, "trait": "trait"}, frozenset({"function"}), imports=frozenset({"use"})),
}
SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.S | re.I)


def lex(text: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in LEXER.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "comment":
            out.append(Token(m.lastgroup or "", m[0], line))
    return out


class Walk:
    """One file: symbols (number, parent, name, kind, first line, last line, signature, decorators) and edges."""

    def __init__(self, text: str, language: str):
        self.tokens, self.language, self.forms = lex(text), language, LANGUAGES[language]
        self.symbols: list[list] = [[0, None, "<module>", "module", 1, text.count("\n") + 1, None, None]]
        self.edges: list[tuple] = []
        self.owners: list[tuple[int, int, str]] = [(0, 0, "file")]  # depth of braces, symbol, what it is the owner of
        self.lines: dict[int, int] = {}  # arrow that a body without a block follows: whose body it is
        self.shared: set[int] = set()  # blocks that belong to a declaration elsewhere
        self.heads: dict[int, int] = {}  # token that opens a block: whose block it is
        self.own: set[int] = set()  # tokens that are heads' own names
        self.types: dict[str, int] = {}

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def past(self, i: int, opened: str = "(", closed: str = ")") -> int:
        """The place after the pair that opens at ``i``."""
        depth = 0
        while i < len(self.tokens):
            depth += (self.text(i) == opened) - (self.text(i) == closed)
            i += 1
            if depth == 0:
                return i
        return i

    def block_after(self, i: int) -> int:
        """The brace that opens a body, or -1 where a statement ends before."""
        while i < len(self.tokens) and self.text(i) not in ("{", ";", "}"):
            i = self.past(i) if self.text(i) == "(" else i + 1
        return i if self.text(i) == "{" else -1

    def declare(self, at: int, kind: str, after: int, owner: int | None = None, signature: str | None = None) -> int:
        number = len(self.symbols)
        parent = self.owners[-1][1] if owner is None else owner
        line = self.tokens[at].line
        self.symbols.append([number, parent, self.text(at).lstrip("$"), kind, line, line, signature, self.decorators(at)])
        self.own.add(at)
        body = self.block_after(after)
        if body >= 0:
            self.heads[body] = number
        return number

    def decorators(self, at: int) -> str | None:
        """Marks with @ on the lines of a head and right above it."""
        found, i, line = [], at - 1, self.tokens[at].line
        while i >= 0 and line - self.tokens[i].line <= 1 and self.text(i) not in (";", "{", "}"):
            if self.text(i).startswith("@"):
                found.append(self.text(i)[1:])
                line = self.tokens[i].line
            i -= 1
        return "," + ",".join(reversed(found)) + "," if found else None

    def signature(self, at: int) -> tuple[str, int]:
        """The parameters that open at ``at``, and the place behind them."""
        end = self.past(at)
        text = " ".join(t.text for t in self.tokens[at:end])
        text = re.sub(r"\s*(::|[(),.:<>\[\]])\s*", r"\1", text)
        return re.sub(r"([&*'])\s+", r"\1", re.sub(r"(?<!:):(?!:)", ": ", text.replace(",", ", "))), end

    def function(self, at: int, owner: int | None = None, method: bool | None = None) -> None:
        i = at + 1
        if self.text(i) == "<":
            i = self.past(i, "<", ">")
        if self.text(i) != "(":
            return
        signature, end = self.signature(i)
        inside = self.symbols[self.owners[-1][1]][3] in TYPE_KINDS if method is None else method
        self.declare(at, "method" if inside else "function", end, owner, signature)

    def imported(self, i: int) -> int:
        """Names that an import brings, up to its end."""
        line, names, first = self.tokens[i].line, [], i
        i += 1
        if self.language == "cpp":
            if i < len(self.tokens) and self.tokens[i].kind == "string":
                names = [self.text(i).strip('"')]
            elif self.text(i) == "<":
                end = self.past(i, "<", ">")
                names = ["".join(t.text for t in self.tokens[i + 1 : end - 1])]
                i = end
        elif self.language == "go":
            stop = self.past(i) if self.text(i) == "(" else i + 2
            while i < min(stop, len(self.tokens)):
                if self.tokens[i].kind == "string":
                    names.append(self.text(i).strip('"`').rpartition("/")[2])
                i += 1
        else:
            while i < len(self.tokens) and self.text(i) != ";" and not (self.language in ("typescript", "javascript") and self.tokens[i].kind == "string"):
                if self.language in ("typescript", "javascript") and self.tokens[i].line > line + 200:
                    break
                if self.named(i) and self.text(i) not in ("from", "type", "static", "as", "function", "const", "default", "self", "crate", "super", "import"):
                    if self.text(i - 1) == "as" and names:
                        names[-1] = names[-1] if self.language != "typescript" or self.text(i - 2) != "*" else self.text(i)
                    elif self.text(i + 1) not in ("::", ".", "\\"):
                        names.append(self.text(i))
                i += 1
            if self.language == "csharp" and "=" in (t.text for t in self.tokens[first:i]):
                names = names[-1:]
        owner = self.owners[-1][1]
        self.edges.extend((owner, n, "imports", None, line) for n in dict.fromkeys(names))
        return i

    def run(self) -> tuple[list[tuple], list[tuple]]:
        i, depth, forms = 0, 0, self.forms
        while i < len(self.tokens):
            t = self.tokens[i]
            before, after = self.text(i - 1), self.text(i + 1)
            owner = self.owners[-1][1]
            if t.text == "{":
                depth += 1
                if i in self.heads:
                    self.owners.append((depth, self.heads[i], "shared" if i in self.shared else "block"))
            elif t.text == "}":
                while len(self.owners) > 1 and self.owners[-1][0] >= depth:
                    _, number, what = self.owners.pop()
                    if what != "shared":
                        self.symbols[number][5] = t.line
                depth = max(0, depth - 1)
            elif t.text == "=>" and i in self.lines:
                self.owners.append((depth, self.lines[i], "line"))
            elif t.text == ";":
                while self.owners[-1][2] == "line" and self.owners[-1][0] == depth:
                    self.symbols[self.owners.pop()[1]][5] = t.line
            elif t.kind != "name" or i in self.own:
                pass
            elif t.text in forms.imports and (self.language != "php" or self.symbols[owner][3] == "module") and not (self.language == "csharp" and after == "(") and before not in (".", "?."):
                i = self.imported(i)
                continue
            elif t.text in forms.types and self.named(i + 1) and before not in (".", "::") and not (t.text == "class" and before == "enum"):
                at = i + 1 + (self.text(i + 1) in ("class", "struct") and self.named(i + 2))
                kind = forms.types[t.text]
                if self.language == "go":
                    kind = {"interface": "interface", "struct": "struct"}.get(self.text(at + 1), "type")
                if self.language != "cpp" or self.text(at + 1) in ("{", ":", "final"):
                    self.types[self.text(at)] = self.declare(at, kind, at + 1)
                    i = at
            elif t.text in forms.blocks:
                end = self.block_after(i)
                words = [self.text(k) for k in range(i + 1, end) if self.named(k)] if end >= 0 else []
                if "for" in words:
                    words = words[words.index("for") + 1 :]
                if words and end >= 0:
                    known = [self.types[w] for w in words if w in self.types]
                    self.heads[end] = known[0] if known else self.placeholder(words[0], t.line)
                    if known:
                        self.shared.add(end)
            elif t.text in forms.functions:
                if self.language == "go" and after == "(":
                    end = self.past(i + 1)
                    kind = [self.text(k) for k in range(i + 2, end - 1) if self.named(k)]
                    if self.named(end):
                        self.function(end, self.types.get(kind[-1]) if kind else None, method=True)
                        i = end
                elif self.named(i + 1):
                    self.function(i + 1)
            elif self.language in ("typescript", "javascript") and t.text in ("const", "let", "var") and self.named(i + 1) and self.arrow(i + 1):
                pass
            elif after == "(" or (after == "<" and self.language in ("java", "csharp", "typescript") and self.text(self.past(i + 1, "<", ">")) == "("):
                self.name_with_parameters(i, owner, before)
            elif after == "!" and self.language == "rust" and self.text(i + 2) in ("(", "[", "{"):
                self.edges.append((owner, t.text, "references", None, t.line))
            i += 1
        return [tuple(s) for s in self.symbols], list(dict.fromkeys(self.edges))

    def placeholder(self, name: str, line: int) -> int:
        """The type of an implementation whose declaration is elsewhere: its methods hang from the module."""
        self.types[name] = len(self.symbols)
        self.symbols.append([len(self.symbols), 0, name, "impl", line, line, None, None])
        return self.types[name]

    def arrow(self, at: int) -> bool:
        """A name that is bound to a function."""
        i = at + 1
        while i < len(self.tokens) and self.text(i) not in ("=", ";", "{", "}") and self.tokens[i].line == self.tokens[at].line:
            i += 1
        if self.text(i) != "=":
            return False
        i += 1 + (self.text(i + 1) == "async")
        if self.text(i) == "function":
            i += 1
        if self.text(i) != "(":
            return False
        signature, end = self.signature(i)
        if self.text(i - 1) != "function":
            while end < len(self.tokens) and self.text(end) not in ("=>", ";", "{", "}") and self.tokens[end].line == self.tokens[at].line:
                end += 1
            if self.text(end) != "=>":
                return False
            if self.text(end + 1) != "{":
                self.lines[end] = self.declare(at, "function", len(self.tokens), signature=signature)
                return True
        self.declare(at, "function", end, signature=signature)
        return True

    def name_with_parameters(self, i: int, owner: int, before: str) -> None:
        t, forms = self.tokens[i], self.forms
        if t.text.startswith(("@", "#")) or t.text.lstrip("$") in KEYWORDS and not (self.language == "rust" and t.text == "new"):
            return
        inside = self.symbols[owner][3] in TYPE_KINDS
        opened = i + 1 if self.text(i + 1) == "(" else self.past(i + 1, "<", ">")
        end = self.past(opened)
        scoped = self.language == "cpp" and before == "::" and self.named(i - 2)
        if (forms.methods and inside or forms.free and self.symbols[owner][3] == "module") and (before not in (".", "->", "::", "new", "=", "return", "(", ",") or scoped):
            k = end
            while k < len(self.tokens) and (self.named(k) or self.text(k) in (":", ",", "<", ">", "->", "|", "[", "]", "&", "*", ".")) and self.text(k) not in ("return",):
                k += 1
            if self.text(k) == "{" or (self.text(k) in (";", "=>") and self.language != "cpp" and inside):
                signature, _ = self.signature(opened)
                parent = self.types.get(self.text(i - 2)) if scoped else None
                number = self.declare(i, "method" if inside or scoped else "function", end, parent, signature)
                if self.text(k) == "=>":
                    self.lines[k] = number
                return
            if self.text(k) == ";" and self.language == "cpp":
                return  # declared here, defined elsewhere
        how = "method" if before in (".", "->", "::", "?.") else "function"
        self.edges.append((owner, t.text.lstrip("$"), "calls", how, t.line))


TYPE_KINDS = frozenset("class interface enum struct trait impl type".split())


def parse(text: str, language: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of one file as the extractor of Python gives them; of a Vue file what its scripts hold."""
    if language == "vue":
        kept = "".join(c if c == "\n" else " " for c in text)
        for m in SCRIPT.finditer(text):
            kept = kept[: m.start(1)] + m[1] + kept[m.end(1) :]
        text, language = kept, "typescript"
    return Walk(text, language).run()
