"""The tools over a folder or a table: each runs one plan and renders one page."""

from __future__ import annotations

import contextlib
import json
import os
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError, EncodingError
from corpusloom.functions.decode import decoded, is_magic
from corpusloom.functions.lines import READ_CHARS
from corpusloom.functions.spans import python_pattern, spans_of
from corpusloom.functions.tokens import PrefixCounter, TokenCounter
from corpusloom.operators import glob as globs
from corpusloom.operators import outline as outlines
from corpusloom.operators import read as reads
from corpusloom.operators import report, search
from corpusloom.operators.pool import Pool, stub
from corpusloom.operators.search import Search
from corpusloom.plans.budget import GLOBAL, BudgetTooSmall, largest_fitting, page_rows, resolve
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.listing import contents, listed, newest
from corpusloom.sources.paths import from_windows, resolved, shown
from corpusloom.sources.tree import corpus_of, sealed, tree_corpus, tree_files

DETAILS, ENTRIES = 256, 250
#: The variable that says how pages are given.
WIRE = "CORPUSLOOM_WIRE"
#: How many of the newest files a page looks at first, then.
NEWEST = (1_000, 30_000)


@dataclass
class Terminal:
    """Where a page ends: state complete, partial or empty; total is None where it isn't known."""

    state: str
    unit: str
    shown_from: int
    shown_to: int
    total: int | None = None
    note: str | None = None


@dataclass
class Page:
    text: str | None
    terminal: Terminal
    returned: int = 0
    budget: int | None = None
    next_call: dict | None = None
    skip_report: dict | None = None
    violations: list = field(default_factory=list)

    @property
    def truncated(self) -> bool:
        return self.terminal.state == "partial"

    def envelope(self) -> str:
        """Compact JSON; what isn't there is left out."""
        usage = {"returned": self.returned} | ({"budget": self.budget} if self.budget else {})
        out = {"token_usage": usage, "truncated": self.truncated, "next_call": self.next_call, "violations": self.violations, "text": self.text, "terminal": {k: v for k, v in asdict(self.terminal).items() if v is not None}, "skip_report": self.skip_report}
        return json.dumps({k: v for k, v in out.items() if v is not None}, ensure_ascii=False, separators=(",", ":"))

    def wire(self, mode: str | None = None, env: dict[str, str] | None = None) -> str:
        """The page as text or envelope: by mode, else by what the environment says, else as text."""
        mode = mode or (os.environ if env is None else env).get(WIRE) or "text"
        if mode not in ("text", "envelope"):
            raise ConfigError(f"unknown wire mode {mode!r}")
        return self.envelope() if mode == "envelope" else self.text if self.text is not None else self.terminal.note or ""


def plural(n: int, unit: str) -> str:
    return f"{n} {unit}" if n == 1 else f"{n} {unit[:-1]}ies" if unit.endswith("y") else f"{n} {unit}s"


def window(line: str, spans: list[tuple[int, int]], most: int = 2000, margin: int = 100) -> str:
    """A line of more than 500 bytes around its first matches; a first match that is longer than the window is cut and says so."""
    if len(line.encode()) <= 500 or not spans:
        return line
    start = max(0, spans[0][0] - margin) if spans[0][1] + margin <= most else spans[0][0]
    end = min(len(line), start + most, max(a + n for a, n in spans if a - start < most) + margin)
    cut = spans[0][0] + spans[0][1] > end
    beyond = sum(1 for a, n in spans[1:] if a + n > end)
    size = f" (line of {len(line.encode())} bytes" + (f", {plural(beyond, 'match')[:-1] + 'es' if beyond > 1 else '1 match'} beyond" if beyond else "") + ")"
    return ("…" if start else "") + line[start:end] + ("…" if end < len(line) else "") + (f" (match of {spans[0][1]} characters cut)" if cut else "") + size


def context_line(line: str) -> str:
    return line if len(line.encode()) <= 500 else f"(line of {len(line)} characters)"


def cut_line(line: str, most: int = READ_CHARS) -> str:
    return line if len(line) <= most else line[:most] + f" … (line of {len(line)} characters cut)"


class Engine:
    """Tools whose paths are relative to root; pages stay within the budgets that the environment sets."""

    def __init__(self, spark: SparkSession, root: str, counter: TokenCounter | None = None, env: dict[str, str] | None = None, pool: Pool | None = None):
        """pool: what the calls of a turn share, through call()."""
        self.spark, self.root, self.count, self.env, self.pool = spark, root, counter or TokenCounter(), env, pool

    def call(self, tool: str, **arguments) -> Page:
        """A page of a tool within its share of the turn's pool; where that is used up, a message that says so and the same call again."""
        if tool not in ("search", "glob", "read", "outline"):
            raise ConfigError(f"unknown tool {tool!r}")
        if self.pool is None:
            return getattr(self, tool)(**arguments)
        with self.pool.begin() as call:
            allowed = call.claim(resolve(tool, self.env))
            page = None
            if not call.exhausted:
                share = Engine(self.spark, self.root, self.count, {f"{GLOBAL}_{tool.upper()}": str(allowed)})
                with contextlib.suppress(BudgetTooSmall):
                    page = getattr(share, tool)(**arguments)
            if page is None:
                text = stub(allowed, self.count)
                page = Page(text, Terminal("partial", "calls", 0, 0), self.count(text), allowed, {"tool": tool, "arguments": arguments})
            call.complete(page.returned)
            return page

    def _path(self, path: str | None) -> str:
        found = resolved(self.root, from_windows(path)) if path else self.root
        if not os.path.exists(found):
            raise ConfigError(f"no such path: {path}")
        return found

    def _placed(self, corpus: Corpus, target: str) -> Corpus:
        """Paths relative to the target while that lies under the root, else absolute."""
        folder = target if os.path.isdir(target) else os.path.dirname(target)
        if not os.path.isabs(shown(os.path.join(folder, "x"), self.root, folder)):
            return corpus
        whole = lambda df, c: df if df is None else df.withColumn(c, F.concat(F.lit(folder.rstrip("/") + "/"), F.col(c)))
        return replace(corpus, files=whole(corpus.files, "rel"), skips=whole(corpus.skips, "path"), encodings=whole(corpus.encodings, "rel"))

    def _finish(self, page: Page, budget: int, tool: str, counted: int | None = None) -> Page:
        """The page, if it keeps to the budget. counted: what it came to piece by piece."""
        page.budget, page.returned = budget, self.count(page.wire("text"))
        if counted is not None and counted != page.returned:
            raise RuntimeError(f"a page was counted as {counted} tokens and has {page.returned}")
        if page.returned > budget:
            raise BudgetTooSmall(tool, budget, "the page")
        return page

    def search(self, pattern: str, path: str | None = None, encoding: str | None = None, fallback_encoding: str | None = None, head_limit: int = ENTRIES, offset: int = 0, line_numbers: bool = True, **options) -> Page:
        """A page of a search; options are those of Search."""
        budget = resolve("search", self.env)
        target = self._path(path)
        s = Search(pattern, **options)
        s.regex(self.spark)  # a bad pattern is an error before any file is read
        single = os.path.isfile(target)
        given = {"pattern": pattern, "path": path, "encoding": encoding, "fallback_encoding": fallback_encoding, **options}
        # all that was asked for, so that the next page searches the same files
        args = {k: v for k, v in given.items() if v is not None} | {"head_limit": head_limit, "line_numbers": line_numbers}
        if single or encoding:
            whole = tree_corpus(self.spark, target, "search", encoding, fallback_encoding, s.glob, s.type)
            if lost := whole.skips.first():
                raise EncodingError(f"{path} can't be searched: {lost.reason}")
        listing = None if single else listed(self.spark, target, "search", s.glob, s.type)
        s = replace(s, glob=None, type=None)  # judged before files are read, by paths within the target
        most = offset + page_rows(head_limit, budget)
        for n in [None] if single or s.output_mode == "summary" else [*NEWEST, None]:
            # the newest files first: where they fill the page, older ones aren't opened
            if n and listing.limit(n + 1).count() <= n:
                continue
            corpus = self._placed(whole if single else corpus_of(contents(newest(listing, n) if n else listing), None, fallback_encoding), target)
            with corpus.held() as held:
                if n is None or search.enough(held, s, most):
                    return self.search_corpus(held, s, head_limit, offset, budget, args, line_numbers, not single)

    def search_corpus(self, corpus: Corpus, s: Search, head_limit: int = ENTRIES, offset: int = 0, budget: int | None = None, args: dict | None = None, line_numbers: bool = True, headers: bool = True) -> Page:
        """A page of a search over any corpus; headers: whether content names its files."""
        budget = budget or resolve("search", self.env)
        skipped = self._skips(corpus, search.capture_skips(corpus, s) if s.output_mode == "content" else None)
        notes = "".join(f" {n}" for n in corpus.notes())
        if s.output_mode == "summary":
            r = search.summary(corpus, s).first()
            note = f"{plural(r.occurrences, 'occurrence')} in {plural(r.files, 'file')}." + notes + self._skip_note(skipped)
            return self._finish(Page(None, Terminal("complete", "files", min(1, r.files), r.files, r.files, note), skip_report=skipped), budget, "search")
        limit = page_rows(head_limit, budget)
        content = s.output_mode == "content"
        if content and sum(s.around):
            rows, more = self._with_context(corpus, s, limit, offset)
        else:
            rows, more = search.page(corpus, s, limit, offset)
        unit = "entry" if content else "file"
        entries = [r for r in rows if not content or "is_match" not in r or r["is_match"]]
        total = None if more else offset + len(entries)
        if not entries:
            every = search.result(corpus, s)
            total = (every.where("is_match") if "is_match" in every.columns else every).count() if offset else 0
            note = "No matches." if not offset else f"Nothing at offset {offset}; {plural(total or 0, unit)} in all."
            return self._finish(Page(None, Terminal("complete", unit, 0, 0, total, note + notes + self._skip_note(skipped)), skip_report=skipped), budget, "search")

        deepest = max(s.around)

        def render(k: int, depth: int = deepest, most: int = 2000) -> str:
            part = more or k < len(entries)
            body = self._content(rows, entries[:k], s, line_numbers, depth, most, headers) if content else "\n".join(r.rel if s.output_mode == "files_with_matches" else f"{r.rel}:{r.occurrences}" for r in entries[:k])
            if s.output_mode == "count":
                body += f"\n\n{plural(sum(r.occurrences for r in entries[:k]), 'occurrence')} shown"
            return f"{body}\n\n({self._shown(unit, offset + 1, offset + k, None if more else total, part)}{notes}{self._skip_note(skipped)})"

        depth, most = deepest, 2000
        fits = lambda k, *how: self.count(render(k, *how)) <= budget
        k = largest_fitting(len(entries), fits)
        if not k:  # one entry: as much context as fits, and where none does, less of its line
            k = 1
            if fits(1, 0):
                depth = largest_fitting(deepest, lambda d: fits(1, d))
            else:
                depth, most = 0, largest_fitting(1999, lambda n: fits(1, 0, n))
            if not most:
                raise BudgetTooSmall("search", budget, "the first entry")
        partial = more or k < len(entries)
        next_call = {"tool": "search", "arguments": (args or {}) | {"offset": offset + k}} if partial else None
        page = Page(render(k, depth, most), Terminal("partial" if partial else "complete", unit, offset + 1, offset + k, total), next_call=next_call, skip_report=skipped)
        return self._finish(page, budget, "search")

    def _with_context(self, corpus: Corpus, s: Search, limit: int, offset: int):
        """Lines around the entries of a page: the entries first, of files that aren't skipped for what they show with their context, then the blocks that hold them."""
        found = search.matching_lines(corpus, s).where("is_match").orderBy(F.desc("mtime_ns"), "rel", "line_no").offset(offset).limit(limit + 1).collect()
        entries, more = found[:limit], len(found) > limit
        keys = self.spark.createDataFrame([(r.rel, r.line_no) for r in entries], "rel string, entry long")
        before, after = s.around
        lines = search.matching_lines(corpus, s)
        near = lines.join(F.broadcast(keys), "rel").where(F.col("line_no").between(F.col("entry") - before, F.col("entry") + after))  # the keys of one page
        near = near.groupBy("rel", "mtime_ns", "line_no", "line").agg(F.max((F.col("line_no") == F.col("entry")).cast("int")).alias("hit"))
        rows = near.orderBy(F.desc("mtime_ns"), "rel", "line_no").withColumn("is_match", F.col("hit") == 1).collect()
        return rows, more

    def _content(self, rows: list, entries: list, s: Search, numbers: bool, depth: int, most: int, headers: bool = True) -> str:
        wanted = {(r.rel, r.line_no) for r in entries} if entries and "line_no" in entries[0] else None
        p = python_pattern(s.regex(self.spark))
        out: list[str] = []
        last_rel, last_no = None, None
        before, after = (min(n, depth) for n in s.around)
        if wanted is None or s.only_matching or s.multiline:
            for r in entries:
                if r.rel != last_rel and headers:
                    out += ([""] if last_rel is not None else []) + [r.rel]
                    last_rel = r.rel
                text = r.matched.replace("\r\n", "\n").replace("\n", "\\n")
                text = text if len(text) <= most else text[:most] + "…"
                out.append(f"{r.line_no}:{text}" if numbers and "line_no" in r else text)
            return "\n".join(out)
        for r in rows:
            key = (r.rel, r.line_no)
            hit = key in wanted
            near = any((r.rel, n) in wanted for n in range(r.line_no - after, r.line_no + before + 1))
            if not hit and not near:
                continue
            if r.rel != last_rel:
                out += ([""] if last_rel is not None else []) + [r.rel] if headers else []
            elif (before or after) and r.line_no > last_no + 1:
                out.append("--")
            last_rel, last_no = r.rel, r.line_no
            text = window(r.line, spans_of(p, r.line), most) if hit else context_line(r.line)
            out.append(f"{r.line_no}{':' if hit else '-'} {text}" if numbers else text)
        return "\n".join(out)

    @staticmethod
    def _shown(unit: str, a: int, b: int, total: int | None, partial: bool) -> str:
        many = plural(2, unit).split(" ", 1)[1]
        text = f"Shown: {unit} {a}." if a == b else f"Shown: {many} {a}-{b}."
        if total is not None and not partial:
            return text + f" All {plural(total, unit)} shown."
        return text + (f" {plural(total, unit)} in all." if total is not None else " More follow.")

    def _skips(self, corpus: Corpus, more: DataFrame | None = None) -> dict | None:
        """Files that were skipped: how many, and the first DETAILS of them by path."""
        skips = corpus.skips
        if skips is None and more is None:
            return None
        skips = more if skips is None else skips if more is None else skips.unionByName(more)
        x = skips.agg(F.count_if(F.col("kind") != "unreachable").alias("files"), F.count_if(F.col("kind") == "unreachable").alias("unreachable")).first()
        if not x.files and not x.unreachable:
            return None
        # what wasn't reached comes before what was, but couldn't be shown
        rows = skips.orderBy(F.col("kind") != "unreachable", "path").limit(DETAILS).collect()
        return {"files": x.files, "unreachable": x.unreachable, "details": [{"path": r.path, "reason": r.reason} for r in rows], "unlisted": x.files + x.unreachable - len(rows)}

    @staticmethod
    def _skip_note(skips: dict | None) -> str:
        return f" {plural(skips['files'] + skips['unreachable'], 'file')} skipped." if skips else ""

    def glob(self, pattern: str | list[str], path: str | None = None, filter_mode: str = "ignore", sort: str = "modified", output_mode: str = "paths", offset: int = 0, limit: int = 100) -> Page:
        """A page of paths that a glob, or a list of globs and vetoes (with ! in front), keeps."""
        if filter_mode not in ("ignore", "all") or output_mode not in ("paths", "details"):
            raise ConfigError("unknown filter or output mode")
        budget = resolve("glob", self.env)
        target = self._path(path)
        files = tree_files(self.spark, target, "all" if filter_mode == "all" else "search", False, pattern).where("error is null")
        rows, total = globs.page(self._placed(Corpus(files.select("rel", "mtime_ns", "size", F.lit("").alias("text"))), target), [], sort, offset, limit)
        if output_mode == "details":
            made = {r.rel: r.entry for r in globs.details(self.spark.createDataFrame(rows, "rel string, mtime_ns long, size long")).collect()} if rows else {}
        shown = [r.rel if output_mode == "paths" else made[r.rel] for r in rows]
        if not shown:
            note = "(No files match.)" if not total else f"(Nothing at offset {offset}; {plural(total, 'file')} match.)"
            return self._finish(Page(note, Terminal("complete", "files", 0, 0, total)), budget, "glob")
        render = lambda k: "\n".join(shown[:k]) + f"\n\n({self._shown('file', offset + 1, offset + k, total, offset + k < total)})"
        k = largest_fitting(len(shown), lambda n: self.count(render(n)) <= budget)
        if not k:
            raise BudgetTooSmall("glob", budget, "one path")
        partial = offset + k < total
        args = {"pattern": pattern, "path": path, "filter_mode": filter_mode, "sort": sort, "output_mode": output_mode, "offset": offset + k, "limit": limit}
        page = Page(render(k), Terminal("partial" if partial else "complete", "files", offset + 1, offset + k, total), next_call={"tool": "glob", "arguments": {a: v for a, v in args.items() if v is not None}} if partial else None)
        return self._finish(page, budget, "glob")

    def _lines(self, path: str, encoding: str | None) -> tuple[list[str], bool]:
        """A file's lines, and whether it is so large that how many there are isn't told."""
        data, _ = sealed(self._path(path))
        if not encoding and is_magic(data):
            raise EncodingError(f"{path} is a binary file")
        d = decoded(data, encoding)
        if d.kind != "text":
            raise EncodingError(f"{path} can't be read as text: {d.reason}" + (f" ({', '.join(d.candidates)})" if d.candidates else ""))
        lines = d.text.split("\n")
        if lines[-1] == "":
            lines.pop()
        return [x.removesuffix("\r") for x in lines], len(data) > reads.COUNTED

    def read(self, file_path: str | None = None, files: list[dict] | None = None, offset: int | None = None, limit: int | None = None, encoding: str | None = None) -> Page:
        """A window of one file's lines, or of several files'."""
        if (file_path is None) == (files is None):
            raise ConfigError("a read takes either file_path or files")
        budget = resolve("read", self.env)
        if files is not None:
            if offset is not None or encoding is not None:
                raise ConfigError("offset and encoding belong to the entries of files")
            return self._read_many(files, limit, budget)
        first = offset or 1
        if first < 1 or limit is not None and limit < 1:
            raise ConfigError("offset and limit count from 1")
        lines, vast = self._lines(file_path, encoding)
        total = len(lines)
        known, of = (None, "") if vast else (total, f" of {total}")
        if not total or first > total:
            note = "(The file is empty.)" if not total else f"(Line {first} is behind the end; the file has {plural(total, 'line')}.)"
            return self._finish(Page(note, Terminal("complete", "lines", 0, 0, total)), budget, "read")
        last = min(total, first + limit - 1) if limit else total
        cut = [cut_line(x) for x in lines[first - 1 : last]]

        shown = [f"{first + i}\t{x}\n" for i, x in enumerate(cut)]

        def tail(k: int) -> str:
            state = "Partial: the budget ends here" if k < len(cut) else "Complete: requested window shown"
            return f"\n({state}; lines {first}-{first + k - 1}{of} shown.)"

        # line by line, each counted once
        k, cost, so_far = 0, 0, PrefixCounter(self.count)
        for i, line in enumerate(shown, 1):
            if (now := so_far.push(line).total(tail(i))) <= budget:
                k, cost = i, now
            elif so_far.total() > budget:
                break
        if not k:
            raise BudgetTooSmall("read", budget, "one line")
        end = first + k - 1
        partial = k < len(cut)
        page = Page("".join(shown[:k]) + tail(k), Terminal("partial" if partial else "complete", "lines", first, end, known), next_call={"file_path": file_path, "offset": end + 1} if partial else None)
        return self._finish(page, budget, "read", cost)

    def _read_many(self, files: list[dict], limit: int | None, budget: int) -> Page:
        entries = [{"path": f["path"], "offset": f.get("offset") or 1, "limit": f.get("limit") or limit, "encoding": f.get("encoding")} for f in files]
        if not 1 <= len(entries) <= reads.MOST_ENTRIES:
            raise ConfigError(f"a read takes 1 to {reads.MOST_ENTRIES} files")
        place = lambda e: os.path.realpath(resolved(self.root, from_windows(e["path"])))
        if len({(place(e), *list(e.values())[1:]) for e in entries}) < len(entries):
            raise ConfigError("an entry is there twice")
        parts: list[tuple[str, list[str], int, int | None]] = []  # head, lines, number of the first and of all
        for e in entries:  # few, each judged for itself
            try:
                lines, vast = self._lines(e["path"], e["encoding"])
            except (ConfigError, EncodingError, OSError) as x:
                parts.append((f"=== {e['path']} ===\n(Error: {x})", [], 0, 0))
                continue
            last = min(len(lines), e["offset"] + e["limit"] - 1) if e["limit"] else len(lines)
            if e["offset"] > len(lines):
                parts.append((f"=== {e['path']} ===\n(Warning: {'the file is empty' if not lines else 'the window begins behind the end'})", [], 0, 0))
                continue
            parts.append((f"=== {e['path']} ", [cut_line(x) for x in lines[e["offset"] - 1 : last]], e["offset"], None if vast else len(lines)))

        def rendered(part: tuple[str, list[str], int, int | None], n: int | None = None) -> str:
            head, lines, first, total = part
            lines = lines if n is None else lines[:n]
            if not lines:
                return head
            return f"{head}(lines {first}-{first + len(lines) - 1}{'' if total is None else f' of {total}'}) ===\n" + "\n".join(f"{i}\t{x}" for i, x in enumerate(lines, first))

        def render(k: int, n: int = 0) -> str:
            """k whole files, and n lines of the next."""
            shown = [rendered(p) for p in parts[:k]] + ([rendered(parts[k], n)] if n else [])
            return "\n\n".join(shown) + f"\n\n({self._shown('file', 1, len(shown), len(parts), k < len(parts))}{' The last one goes on.' if n else ''})"

        k = largest_fitting(len(parts), lambda n: self.count(render(n)) <= budget)
        n = largest_fitting(len(parts[k][1]) - 1, lambda n: self.count(render(k, n)) <= budget) if k < len(parts) and parts[k][1] else 0
        if not k and not n:
            raise BudgetTooSmall("read", budget, "the first file; read it alone")
        partial = k < len(parts)
        rest = [{a: v for a, v in e.items() if v is not None} for e in entries[k:]]
        if n:  # go on within the file that was cut
            rest[0]["offset"] += n
            if "limit" in rest[0]:
                rest[0]["limit"] -= n
        page = Page(render(k, n), Terminal("partial" if partial else "complete", "files", 1, k + bool(n), len(parts)), next_call={"files": rest} if partial else None)
        return self._finish(page, budget, "read")

    def outline(self, path: str, depth: int | None = 2) -> Page:
        """All symbols of a file down to a depth; never in parts."""
        budget = resolve("outline", self.env)
        target = self._path(path)
        language = outlines.EXTENSIONS.get(target.rsplit(".", 1)[-1] if "." in target.rsplit("/", 1)[-1][1:] else "")
        if language is None:
            raise ConfigError(f"no known language: {path}")
        data, _ = sealed(target)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            d = decoded(data)
            if d.kind != "text":
                raise EncodingError(f"{path} can't be outlined: {d.kind} {d.reason}") from None
            text = d.text
        lines = outlines.tree_lines(outlines.outline(text, language), depth)
        page = "\n".join(lines) or "(No symbols found.)"
        if self.count(page) > budget:
            raise BudgetTooSmall("outline", budget, "the whole outline")
        return self._finish(Page(page, Terminal("complete", "entries", min(1, len(lines)), len(lines), len(lines))), budget, "outline")

    def index(self) -> str:
        """A report on the folder: files by extension and their bytes."""
        files = tree_files(self.spark, self.root, "report", content=False).where("error is null")
        corpus = Corpus(files.select("rel", "mtime_ns", "size", F.lit("").alias("text")))
        t = report.totals(corpus).first()
        rows = report.by_extension(corpus).collect()
        return "\n".join([f"{plural(t.files, 'file')}, {t.bytes} bytes", *(f"  {r.extension or '(none)'}: {r.files}" for r in rows)])

    def status(self, version: str = "0.1.0") -> str:
        files = tree_files(self.spark, self.root, "report", content=False).where("error is null")
        t = report.totals(Corpus(files.select("rel", "mtime_ns", "size", F.lit("").alias("text")))).first()
        return f"version {version}\nroot {self.root}\nno index\n{plural(t.files, 'file')}, {t.bytes} bytes"
