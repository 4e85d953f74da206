"""Code in brace and `end` languages as facts with relations: modules and imports, types and what they extend, functions and what they call,
routes and their handlers. One scanner; a language is a row of patterns."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import matches_glob

SCHEMA = ("file string, line int, end_line int, kind string, name string, symbol_kind string, language string, exported boolean, cyclomatic int, loop_depth int, "
          "relations array<struct<kind:string,target:string>>, props map<string,string>")

VERBS = "get|post|put|delete|patch|head|options"
#: By language: file endings, imports, types (mods, kind, name, rest), functions (mods, owner, name), routes (verb, path, handler). Patterns see code
#: with comments blanked; those of types and functions with strings blanked as well.
LANGUAGES: dict[str, dict[str, str]] = {
    "go": {
        "ends": ".go", "imports": r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./~-]+)"\s*$|^\s*import\s+(?:\w+\s+)?"([^"]+)"',
        "types": r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)(?P<rest>)\s*\{", "functions": r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(",
        "routes": r'\.(?P<verb>GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch|HandleFunc|Handle)\(\s*"(?:(?P<in>[A-Z]+)\s+)?(?P<path>/[^"]*)"(?:\s*,\s*(?P<handler>[\w.]+)\s*\))?'},
    "typescript": {
        "ends": ".ts .tsx .js .jsx .mjs", "imports": r"""^\s*import\s+(?:[^'";]*?\s+from\s+)?['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)|^\s*export\s+[^'";]*?\s+from\s+['"]([^'"]+)['"]""",
        "types": r"^\s*(?P<mods>(?:export\s+|default\s+|abstract\s+|declare\s+)*)(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?P<rest>[^{;]*)\{",
        "functions": r"^\s*(?P<mods>(?:export\s+|default\s+|async\s+)*)function\s*\*?\s*(?P<name>\w+)|^\s*(?P<mods2>(?:export\s+)?)(?:const|let|var)\s+(?P<name2>\w+)[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>\s*\{|^\s+(?P<mods3>(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+)*)(?!(?:if|for|while|switch|catch|return|function|else|do|new|await)\b)(?P<name3>\w+)\s*\([^)\n]*\)\s*(?::[^{;\n]+)?\{",
        "routes": r"""\b(?:app|router|server|api)\.(?P<verb>""" + VERBS + r""")\(\s*['"`](?P<path>/[^'"`]*)['"`](?:\s*,\s*(?P<handler>[\w.]+)\s*\))?|@(?P<verb2>Get|Post|Put|Delete|Patch)\(\s*['"](?P<path2>[^'"]*)['"]\s*\)"""},
    "java": {
        "ends": ".java", "imports": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", "types": r"^\s*(?P<mods>(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*)(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)(?P<rest>[^{;]*)\{",
        "functions": r"^\s*(?P<mods>(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*)(?:<[^>]+>\s*)?(?!(?:return|new|else|throw|case|assert)\b)[\w.<>\[\],? ]+?\s+(?P<name>\w+)\s*\([^;{)]*\)\s*(?:throws\s+[\w., ]+)?\{",
        "routes": r'@(?P<verb>Get|Post|Put|Delete|Patch|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?"(?P<path>[^"]*)"'},
    "kotlin": {
        "ends": ".kt .kts", "imports": r"^\s*import\s+([\w.]+(?:\.\*)?)", "types": r"^\s*(?P<mods>(?:(?:public|private|internal|open|abstract|data|sealed|enum|inner)\s+)*)(?P<kind>class|interface|object)\s+(?P<name>\w+)(?P<rest>[^{\n]*)\{",
        "functions": r"^\s*(?P<mods>(?:(?:public|private|internal|protected|open|override|suspend|inline|operator)\s+)*)fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\(", "routes": r'@(?P<verb>Get|Post|Put|Delete|Patch|Request)Mapping\(\s*"(?P<path>[^"]*)"'},
    "scala": {
        "ends": ".scala", "imports": r"^\s*import\s+([\w.]+)", "types": r"^\s*(?P<mods>(?:(?:private|protected|sealed|abstract|final|case|implicit)\s+)*)(?P<kind>class|trait|object)\s+(?P<name>\w+)(?P<rest>[^{\n]*)\{",
        "functions": r"^\s*(?P<mods>(?:(?:private|protected|override|final|implicit)(?:\[\w+\])?\s+)*)def\s+(?P<name>\w+)", "routes": r'(?P<verb>get|post|put|delete)\("(?P<path>/[^"]*)"\)'},
    "csharp": {
        "ends": ".cs", "imports": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "types": r"^\s*(?P<mods>(?:(?:public|internal|private|protected|abstract|sealed|static|partial)\s+)*)(?P<kind>class|interface|struct|record|enum)\s+(?P<name>\w+)(?P<rest>[^{;]*)\{",
        "functions": r"^\s*(?P<mods>(?:(?:public|internal|private|protected|static|virtual|override|async|abstract|sealed)\s+)+)(?:[\w.<>\[\],? ]+?\s+)?(?P<name>\w+)\s*\([^;{)]*\)\s*(?:where[^{]*)?\{",
        "routes": r'\[Http(?P<verb>Get|Post|Put|Delete|Patch)\("(?P<path>[^"]*)"\)\]|\.Map(?P<verb2>Get|Post|Put|Delete)\(\s*"(?P<path2>[^"]*)"(?:\s*,\s*(?P<handler>[\w.]+)\s*\))?'},
    "rust": {
        "ends": ".rs", "imports": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "types": r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?P<kind>struct|enum|trait|impl)(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)(?P<rest>[^{;]*)\{",
        "functions": r"^\s*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*)fn\s+(?P<name>\w+)", "routes": r'#\[(?P<verb>' + VERBS + r')\("(?P<path>[^"]*)"\)\]|\.route\(\s*"(?P<path2>/[^"]*)"\s*,\s*(?P<verb2>' + VERBS + r')\((?P<handler>[\w:]+)\)'},
    "swift": {
        "ends": ".swift", "imports": r"^\s*import\s+([\w.]+)", "types": r"^\s*(?P<mods>(?:(?:public|private|internal|open|final|fileprivate)\s+)*)(?P<kind>class|struct|protocol|enum|extension|actor)\s+(?P<name>\w+)(?P<rest>[^{\n]*)\{",
        "functions": r"^\s*(?P<mods>(?:(?:public|private|internal|open|static|override|mutating|fileprivate|class|final)\s+)*)func\s+(?P<name>\w+)", "routes": r'\.(?P<verb>get|post|put|delete)\("(?P<path>[^"]*)"'},
    "php": {
        "ends": ".php", "imports": r"^\s*use\s+([\w\\]+)", "types": r"^\s*(?P<mods>(?:(?:abstract|final|readonly)\s+)*)(?P<kind>class|interface|trait|enum)\s+(?P<name>\w+)(?P<rest>[^{;]*)\{",
        "functions": r"^\s*(?P<mods>(?:(?:public|private|protected|static|abstract|final)\s+)*)function\s+&?(?P<name>\w+)", "routes": r"""Route::(?P<verb>get|post|put|delete|patch)\(\s*['"](?P<path>[^'"]*)['"]"""},
    "dart": {
        "ends": ".dart", "imports": r"^\s*(?:import|export)\s+['\"]([^'\"]+)['\"]", "types": r"^\s*(?P<mods>(?:abstract\s+|sealed\s+|base\s+)*)(?P<kind>class|mixin|enum|extension)\s+(?P<name>\w+)(?P<rest>[^{;]*)\{",
        "functions": r"^\s*(?P<mods>(?:static\s+|external\s+)*)(?!(?:return|new|else|throw|if|for|while|switch|await)\b)[\w<>?,\[\] ]+?\s+(?P<name>\w+)\s*\([^;{)]*\)\s*(?:async\*?\s*)?\{", "routes": r"router\.(?P<verb>get|post|put|delete)\('(?P<path>[^']*)'"},
    "c": {
        "ends": ".c .h .cc .cpp .hpp", "imports": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "types": r"^\s*(?P<mods>)(?:typedef\s+)?(?P<kind>struct|class|enum|union)\s+(?P<name>\w+)(?P<rest>[^{;()]*)\{",
        "functions": r"^(?P<mods>(?:static\s+|inline\s+|extern\s+)*)(?!(?:else|return|typedef|if|for|while|switch)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&](?:(?P<owner>\w+)::)?(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?\{", "routes": r"(?!)"},
    "ruby": {
        "ends": ".rb", "imports": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", "types": r"^(?P<indent>\s*)(?P<kind>class|module)\s+(?P<name>[\w:]+)(?P<rest>[^\n]*)", "functions": r"^(?P<indent>\s*)def\s+(?:self\.)?(?P<name>[\w?!=]+)",
        "routes": r"""^\s*(?P<verb>get|post|put|delete|patch)\s+['"](?P<path>[^'"]*)['"](?:\s*(?:,\s*to:|=>)\s*['"](?P<handler>[^'"]*)['"])?"""},
}

WORDS = set("if for while switch catch return function func fn def new else do throw assert sizeof await yield super this self typeof in not and or match when guard let elsif unless until foreach using lock fixed where select case init".split())


class Scan:
    """The facts of one file."""

    def __init__(self, path: str, body: str, language: str):
        import re
        from bisect import bisect_right

        self.re, self.path, self.language, self.spec = re, path, language, LANGUAGES[language]
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        comment = r"#[^\n]*" if language == "ruby" else r"//[^\n]*|/\*.*?\*/"
        string = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
        if language == "rust":
            string = r'"(?:\\.|[^"\\])*"'
        self.code = re.sub(f"({string})|{comment}", lambda m: m.group() if m.group(1) else blank(m), body, flags=re.S)
        self.bare = re.sub(string, blank, self.code, flags=re.S)
        starts = [0] + [m.end() for m in re.finditer("\n", body)]
        self.line = lambda at: bisect_right(starts, at)
        self.module = path.rpartition("/")[0] or "."
        self.close, stack = {}, []
        for m in re.finditer(r"[{}]", self.bare):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def first(self, m, *names):
        groups = m.groupdict()
        return next((groups[n + k] for k in ("", "2", "3") for n in names if groups.get(n + k)), None)

    def end(self, m) -> int:
        """Where what a match opens is closed: its brace, or in `end` languages the `end` that is indented as it is."""
        if "indent" in m.groupdict():
            stop = self.re.compile(r"^" + self.re.escape(m["indent"].rpartition("\n")[2]) + r"end\b", self.re.M).search(self.bare, m.end())
            return stop.end() if stop else m.end()
        brace = self.bare.find("{", m.end() - 1)
        over = self.re.compile(r"[;\n]\s*\n|;").search(self.bare, m.end() - 1)
        if brace < 0 or (over and over.start() < brace and "{" not in m.group()):
            return m.end()
        return self.close.get(brace, m.end())

    def exported(self, name: str, mods: str | None) -> bool:
        mods = mods or ""
        if self.language == "go":
            return name[:1].isupper()
        if self.language in ("typescript", "rust"):
            return "export" in mods or mods.lstrip().startswith("pub")
        if self.language in ("java", "csharp", "swift"):
            return "public" in mods or "open" in mods
        if self.language == "c":
            return "static" not in mods
        return not self.re.search(r"private|protected|internal", mods) and not name.startswith("_")

    def loops(self, start: int, stop: int) -> int:
        """The deepest nesting of loops."""
        deepest, open_ = 0, []
        for m in self.re.compile(r"\b(?:for|foreach|while|loop)\b").finditer(self.bare, start, stop):
            brace = self.bare.find("{", m.end(), stop)
            if brace < 0:
                continue
            open_ = [e for e in open_ if e > m.start()] + [self.close.get(brace, stop)]
            deepest = max(deepest, len(open_))
        return deepest

    def rows(self):
        re, spec = self.re, self.spec
        types = []
        for m in re.finditer(spec["types"], self.bare, re.M):
            types.append((m.start("name"), self.end(m), m["name"], m["kind"], (m.groupdict().get("mods") or ""), m["rest"] or ""))
        owner_at = lambda at: next((t[2] for t in sorted(types, key=lambda t: t[1] - t[0]) if t[0] < at < t[1]), None)
        imports = sorted({next(g for g in m.groups() if g) for m in re.finditer(spec["imports"], self.code, re.M)})
        yield (self.path, 1, self.code.count("\n") + 1, "module", self.module, "file", True, 0, 0, [("imports", i) for i in imports], {})
        named = {}
        for at, stop, name, kind, mods, rest in types:
            if kind == "impl":
                continue
            above = re.sub(r"\b(?:extends|implements|with|public|private|protected|virtual)\b|[:<(]", ",", re.sub(r"<[^<>]*>|\([^()]*\)", "", rest))
            bases = [b.strip() for b in above.split(",") if re.fullmatch(r"[\w.:\\]+", b.strip())]
            full = f"{self.module}.{name}"
            yield (self.path, self.line(at), self.line(stop), "symbol", full, kind, self.exported(name, mods), 0, 0, [("declares", self.module)] + [("implements", b) for b in bases], {})
        found = []
        for m in re.finditer(spec["functions"], self.bare, re.M):
            name = self.first(m, "name")
            if name in WORDS:
                continue
            at = next(m.start(n) for n in ("name", "name2", "name3") if m.groupdict().get(n))
            owner = m.groupdict().get("owner") or owner_at(at)
            found.append((at, self.end(m), name, owner, self.first(m, "mods")))
            named.setdefault(name, set()).add(".".join(x for x in (self.module, owner, name) if x))
        for at, stop, name, owner, mods in found:
            full = ".".join(x for x in (self.module, owner, name) if x)
            body = self.bare.find("{", at, stop)
            begin = (body + 1) if body >= 0 else self.bare.find("\n", at, stop)
            calls = set()
            for c in re.compile(r"(?<![\w.$@])((?:[A-Za-z_]\w*(?:\.|::|->|\?\.))*[A-Za-z_]\w*[?!]?)\s*\(").finditer(self.bare, begin if begin > 0 else at, stop) if begin > 0 else ():
                target = c.group(1).replace("?.", ".")
                short = re.split(r"\.|::|->", target)[-1]
                if short in WORDS or target == name and c.start() == at:
                    continue
                own = named.get(short, ())
                calls.add(next(iter(own)) if len(own) == 1 and re.fullmatch(r"(?:(?:this|self)(?:\.|->|::))?\w+[?!]?", target) else target)
            score = 1 + len(re.findall(r"\b(?:if|elif|elsif|for|foreach|while|case|catch|when|unless|rescue|guard)\b|&&|\|\||\?(?![.?:])", self.bare[begin:stop])) if begin > 0 else 1
            relations = [("declares", f"{self.module}.{owner}" if owner else self.module)] + [("calls", t) for t in sorted(calls)]
            yield (self.path, self.line(at), self.line(stop), "symbol", full, "method" if owner else "function", self.exported(name, mods), score, self.loops(begin, stop) if begin > 0 else 0, relations, {})
        for m in re.finditer(spec["routes"], self.code, re.M):
            verb, path, handler = (self.first(m, n) for n in ("verb", "path", "handler"))
            verb = (m.groupdict().get("in") or verb or "").upper()
            verb = "*" if verb in ("HANDLE", "HANDLEFUNC", "REQUEST", "") else verb
            yield (self.path, self.line(m.start()), self.line(m.end()), "route", f"{verb} {path}", "http", True, 0, 0, [], {"method": verb, "path": path or "", "role": "server"} | ({"handler": handler} if handler else {}))


def extract_code(files: DataFrame) -> DataFrame:
    """Facts of the files (path, body) whose endings LANGUAGES names. A file is read by itself, so files spread over tasks; a target is as
    written, or the file's own symbol where one alone has the name. Names: folder, then owner, then symbol, joined by '.'."""
    ends = {e: n for n, spec in LANGUAGES.items() for e in spec["ends"].split()}
    globs = [g for e in ends for g in (f"**/*{e}", f"*{e}")]

    def run(batches):
        import pandas as pd

        columns = ["file", "line", "end_line", "kind", "name", "symbol_kind", "exported", "cyclomatic", "loop_depth", "relations", "props", "language"]
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["body"], strict=True):
                language = ends.get("." + path.rpartition(".")[2])
                if language:
                    for r in Scan(path, body or "", language).rows():
                        rows.append((*r[:9], [{"kind": k, "target": t} for k, t in r[9]], r[10], language))
            yield pd.DataFrame(rows, columns=columns)[["file", "line", "end_line", "kind", "name", "symbol_kind", "language", "exported", "cyclomatic", "loop_depth", "relations", "props"]]

    return files.filter(matches_glob(F.col("path"), globs)).select("path", "body").mapInPandas(run, SCHEMA)
