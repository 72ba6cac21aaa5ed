"""Globs over slash-separated paths, as anchored regular expressions.

`*` and `?` stay within a component, `**` as a whole component takes any
number of them, `{a,b}` is a choice and `[..]` a class. A list of globs keeps
a path if any including glob matches (or there is none) and no `!` glob does.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError

# fixed values: file types and their globs
TYPES = {
    "asm": ["*.asm", "*.s", "*.S"],
    "awk": ["*.awk"],
    "bat": ["*.bat"],
    "bazel": ["*.bazel", "*.bazelrc", "*.BUILD", "*.bzl", "BUILD", "MODULE.bazel", "WORKSPACE", "WORKSPACE.bazel", "WORKSPACE.bzlmod"],
    "bitbake": ["*.bb", "*.bbappend", "*.bbclass", "*.conf", "*.inc"],
    "c": ["*.[chH]", "*.[chH].in", "*.cats"],
    "clojure": ["*.clj", "*.cljc", "*.cljs", "*.cljx"],
    "cmake": ["*.cmake", "CMakeLists.txt"],
    "config": ["*.cfg", "*.conf", "*.config", "*.ini"],
    "cpp": ["*.[ChH]", "*.cc", "*.[ch]pp", "*.[ch]xx", "*.hh", "*.inl", "*.[ChH].in", "*.cc.in", "*.[ch]pp.in", "*.[ch]xx.in", "*.hh.in"],
    "cs": ["*.cs"],
    "csharp": ["*.cs"],
    "css": ["*.css", "*.scss"],
    "csv": ["*.csv"],
    "cuda": ["*.cu", "*.cuh"],
    "cython": ["*.pyx", "*.pxi", "*.pxd"],
    "dart": ["*.dart"],
    "diff": ["*.patch", "*.diff"],
    "docker": ["*Dockerfile*"],
    "elixir": ["*.ex", "*.eex", "*.exs", "*.heex", "*.leex", "*.livemd"],
    "elm": ["*.elm"],
    "erlang": ["*.erl", "*.hrl"],
    "fortran": ["*.f", "*.F", "*.f77", "*.F77", "*.pfo", "*.f90", "*.F90", "*.f95", "*.F95"],
    "fsharp": ["*.fs", "*.fsx", "*.fsi"],
    "go": ["*.go"],
    "gradle": ["*.gradle", "*.gradle.kts", "gradle.properties", "gradle-wrapper.*", "gradlew", "gradlew.bat"],
    "graphql": ["*.graphql", "*.graphqls"],
    "groovy": ["*.groovy", "*.gradle"],
    "h": ["*.h", "*.hh", "*.hpp"],
    "haskell": ["*.hs", "*.lhs", "*.cpphs", "*.c2hs", "*.hsc"],
    "html": ["*.htm", "*.html", "*.ejs"],
    "java": ["*.java", "*.jsp", "*.jspx", "*.properties"],
    "jl": ["*.jl"],
    "js": ["*.js", "*.jsx", "*.vue", "*.cjs", "*.mjs"],
    "json": ["*.json", "composer.lock", "*.sarif"],
    "jsonl": ["*.jsonl"],
    "julia": ["*.jl"],
    "jupyter": ["*.ipynb", "*.jpynb"],
    "kotlin": ["*.kt", "*.kts"],
    "less": ["*.less"],
    "lisp": ["*.el", "*.jl", "*.lisp", "*.lsp", "*.sc", "*.scm"],
    "log": ["*.log"],
    "lua": ["*.lua"],
    "make": ["[Gg][Nn][Uu]makefile", "[Mm]akefile", "[Gg][Nn][Uu]makefile.am", "[Mm]akefile.am", "[Gg][Nn][Uu]makefile.in", "[Mm]akefile.in", "*.mk", "*.mak"],
    "markdown": ["*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"],
    "md": ["*.markdown", "*.md", "*.mdown", "*.mdwn", "*.mkd", "*.mkdn", "*.mdx"],
    "meson": ["meson.build", "meson_options.txt", "meson.options"],
    "nix": ["*.nix"],
    "objc": ["*.h", "*.m"],
    "objcpp": ["*.h", "*.mm"],
    "ocaml": ["*.ml", "*.mli", "*.mll", "*.mly"],
    "perl": ["*.perl", "*.pl", "*.PL", "*.plh", "*.plx", "*.pm", "*.t"],
    "php": ["*.php", "*.php3", "*.php4", "*.php5", "*.php7", "*.php8", "*.pht", "*.phtml"],
    "protobuf": ["*.proto"],
    "ps": ["*.cdxml", "*.ps1", "*.ps1xml", "*.psd1", "*.psm1"],
    "puppet": ["*.epp", "*.erb", "*.pp", "*.rb"],
    "py": ["*.py", "*.pyi"],
    "python": ["*.py", "*.pyi"],
    "r": ["*.R", "*.r", "*.Rmd", "*.rmd", "*.Rnw", "*.rnw"],
    "rst": ["*.rst"],
    "ruby": ["config.ru", "Gemfile", ".irbrc", "Rakefile", "*.gemspec", "*.rb", "*.rbw"],
    "rust": ["*.rs"],
    "sass": ["*.sass", "*.scss"],
    "scala": ["*.scala", "*.sbt"],
    "sh": ["*.bash", "*.bashrc", "*.csh", "*.cshrc", "*.ksh", "*.kshrc", "*.sh", "*.tcsh", "*.zsh", ".bash_login", ".bash_logout", ".bash_profile", ".bashrc", ".cshrc", ".kshrc", ".login", ".logout", ".profile", ".tcshrc", ".zlogin", ".zlogout", ".zprofile", ".zshenv", ".zshrc", "bash_login", "bash_logout", "bash_profile", "bashrc", "profile", "zlogin", "zlogout", "zprofile", "zshenv", "zshrc"],
    "sql": ["*.sql", "*.psql"],
    "svelte": ["*.svelte"],
    "svg": ["*.svg"],
    "swift": ["*.swift"],
    "tcl": ["*.tcl"],
    "tex": ["*.tex", "*.ltx", "*.cls", "*.sty", "*.bib", "*.dtx", "*.ins"],
    "tf": ["*.tf", "*.tf.json", "*.tfvars", "*.tfvars.json", "*.terraformrc", "terraform.rc", "*.tfrc"],
    "thrift": ["*.thrift"],
    "toml": ["*.toml", "Cargo.lock"],
    "ts": ["*.cts", "*.mts", "*.ts", "*.tsx"],
    "txt": ["*.txt"],
    "typescript": ["*.cts", "*.mts", "*.ts", "*.tsx"],
    "vb": ["*.vb"],
    "verilog": ["*.v", "*.vh", "*.sv", "*.svh"],
    "vhdl": ["*.vhd", "*.vhdl"],
    "vim": ["*.vim", ".vimrc", ".gvimrc", "vimrc", "gvimrc", "_vimrc", "_gvimrc"],
    "vue": ["*.vue"],
    "xml": ["*.dtd", "*.rng", "*.sch", "*.xhtml", "*.xjb", "*.xml", "*.xml.dist", "*.xsd", "*.xsl", "*.xslt"],
    "yaml": ["*.yaml", "*.yml"],
    "zig": ["*.zig"],
}


def as_regex(glob: str, anywhere: bool = False) -> str:
    """A regex for whole paths; with anywhere, a glob without a slash matches in any folder."""
    if not glob:
        raise ConfigError("a glob is empty")
    if anywhere and "/" not in glob.rstrip("/"):
        glob = "**/" + glob
    out, i, depth = "", 0, 0
    glob = glob.removeprefix("./").removeprefix("/")
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/"):
            j = i + 2
            if j == len(glob):
                out += ".*"
                i = j
                continue
            if glob[j] == "/":
                out += "(?:[^/]+/)*"
                i = j + 1
                continue
        if c == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[":
            j = glob.find("]", i + 2)
            if j < 0:
                raise ConfigError(f"a class is not closed in glob {glob!r}")
            body = glob[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += f"(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]"
            i = j
        elif c == "{":
            out += "(?:"
            depth += 1
        elif c == "}" and depth:
            out += ")"
            depth -= 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ConfigError(f"a choice is not closed in glob {glob!r}")
    return rf"(?s)\A{out}\z"


def as_list(globs: str | list[str] | None) -> list[str]:
    return [] if globs is None else [globs] if isinstance(globs, str) else list(globs)


def glob_filter(path: Column, globs: str | list[str] | None) -> Column | None:
    """The condition of a list of globs, or None if it is empty."""
    globs = as_list(globs)
    if any(g == "!" for g in globs):
        raise ConfigError("a glob is a bare '!'")
    good = [path.rlike(as_regex(g)) for g in globs if not g.startswith("!")]
    bad = [~path.rlike(as_regex(g[1:])) for g in globs if g.startswith("!")]
    parts = ([reduce(Column.__or__, good)] if good else []) + bad
    return reduce(Column.__and__, parts) if parts else None


def type_filter(path: Column, name: str) -> Column:
    """Paths of a named file type."""
    if name not in TYPES:
        raise ConfigError(f"unknown file type {name!r}")
    return reduce(Column.__or__, (path.rlike(as_regex(g, anywhere=True)) for g in TYPES[name]))


def matches(path: str, globs: list[str]) -> bool:
    """The same decision for one path, on the driver or in a source."""
    fits = lambda g: re.search(as_regex(g).replace(r"\z", r"\Z"), path) is not None
    good = [g for g in globs if not g.startswith("!")]
    return (not good or any(map(fits, good))) and not any(fits(g[1:]) for g in globs if g.startswith("!"))


def wanted(path: str, globs: str | list[str] | None, name: str | None) -> bool:
    """glob_filter() and type_filter() for one path."""
    of_type = lambda: any(re.search(as_regex(g, anywhere=True).replace(r"\z", r"\Z"), path) for g in TYPES[name])
    return matches(path, as_list(globs)) and (not name or of_type())


def extension(path: Column) -> Column:
    """What follows the last dot of a file name, '' without one; a leading dot doesn't count."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
