"""Which language a file name stands for, and which chunker takes it."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

# Extensions of each language (case-sensitive), and whole file names, which go first.
EXTENSIONS = {
    "awk": "awk",
    "batchfile": "bat cmd",
    "bash": "bash ebuild eclass ksh sh zsh",
    "c": "c h",
    "c#": "cs",
    "c++": "C CPP H c++ cc cp cpp cxx h++ hh hpp hxx tpp",
    "clojure": "clj cljc",
    "cmake": "cmake",
    "cobol": "cob",
    "coffeescript": "coffee",
    "common lisp": "cl lisp",
    "css": "css",
    "cuda": "cu cuh",
    "cython": "pxd pxi pyx",
    "d": "d di",
    "dart": "dart",
    "delphi": "dpr pas",
    "diff": "diff patch",
    "docker": "docker",
    "elixir": "eex ex exs leex",
    "emacslisp": "el",
    "erlang": "erl hrl",
    "f#": "fs fsi fsx",
    "fortran": "F F90 f f90",
    "go": "go",
    "graphql": "graphql",
    "groovy": "gradle groovy",
    "haskell": "hs",
    "html": "htm html xhtml",
    "ini": "cfg ini",
    "java": "java",
    "javascript": "cjs js jsm mjs",
    "json": "json jsonl ndjson",
    "jsx": "jsx",
    "julia": "jl",
    "kotlin": "kt kts",
    "lesscss": "less",
    "lua": "lua wlua",
    "makefile": "mak mk",
    "markdown": "markdown md",
    "nasm": "asm nasm",
    "nimrod": "nim nimrod",
    "objective-c": "m",
    "objective-c++": "mm",
    "ocaml": "ml mli mll mly",
    "perl": "perl pl pm",
    "php": "inc php php3 php4 php5",
    "powershell": "ps1 psm1",
    "properties": "properties",
    "protocol buffer": "proto",
    "python": "bzl py pyi pyw tac",
    "r": "r",
    "racket": "rkt rktd rktl",
    "restructuredtext": "rest rst",
    "ruby": "gemspec rake rb rbw rbx",
    "rust": "rs",
    "s": "R S",
    "sass": "sass",
    "scala": "scala",
    "scheme": "scm ss",
    "scss": "scss",
    "sql": "sql",
    "swift": "swift",
    "systemverilog": "sv svh",
    "tcl": "rvt tcl",
    "terraform": "hcl tf",
    "tex": "aux tex toc",
    "text only": "txt",
    "thrift": "thrift",
    "toml": "toml",
    "tsx": "tsx",
    "typescript": "cts mts ts",
    "vb.net": "bas vb",
    "verilog": "v",
    "vhdl": "vhd vhdl",
    "viml": "vim",
    "xml": "rss wsdl xml xsd xsl",
    "yaml": "yaml yml",
    "zig": "zig",
}
FILE_NAMES = {
    "bash": ".bashrc .kshrc .zshrc PKGBUILD bashrc kshrc zshrc",
    "cmake": "CMakeLists.txt",
    "docker": "Dockerfile",
    "json": "Pipfile.lock",
    "makefile": "GNUmakefile Makefile makefile",
    "python": "BUCK BUILD BUILD.bazel SConscript SConstruct WORKSPACE",
    "ruby": "Gemfile Rakefile Vagrantfile",
    "toml": "Pipfile poetry.lock",
    "viml": ".vimrc",
    "ini": ".editorconfig",
}
LANGUAGE_BY_EXTENSION = {f".{e}": language for language, own in EXTENSIONS.items() for e in own.split()}
LANGUAGE_BY_NAME = {name: language for language, own in FILE_NAMES.items() for name in own.split()}
BRACE_LANGUAGES = ("javascript", "jsx", "typescript", "tsx")


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def detect_language(path: Column) -> Column:
    """Language name by file name or extension, null when unknown. Literal maps of fixed size, so no join."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(
        F.try_element_at(_table(LANGUAGE_BY_NAME), name), F.try_element_at(_table(LANGUAGE_BY_EXTENSION), paths.raw_extension(path))
    )


def route_chunker(path: Column) -> Column:
    language = detect_language(path)
    return (
        F.when(F.lower(path).endswith(".ipynb"), "notebook")
        .when(language.isNotNull() & (language != "text only"), "code")
        .otherwise("text")
    )
