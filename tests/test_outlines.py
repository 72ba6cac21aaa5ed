"""Outlines of files with what is hard about each language: (label, name, depth, first line, last line) of all symbols, in order."""

import gc
import tracemalloc

import pytest

from corpusloom.operators.outline import bare_code, outline, python_symbols, symbols

RUST = r'''//! fn not_code() {}
/* outer /* fn inner() { */ still a comment { */
pub mod retry {
    pub const MOST: usize = 5;
    static NAME: &str = "fn text() { }";
    pub(crate) static mut COUNT: u8 = b'{';

    #[derive(Debug, Clone)]
    pub struct Policy<'a, T: Default = ()> {
        pub name: &'a str,
        pub more: T,
    }

    pub struct Unit;
    pub struct Pair(u8, u8);

    pub enum Kind {
        One,
        Two { x: u8 },
    }

    pub union Bits {
        a: u32,
        b: f32,
    }

    pub trait Waits: Send {
        const LONGEST: u64;
        type Out;
        fn wait(&self) -> Self::Out;
        fn twice(&self) -> u64 {
            let c = '}';
            2
        }
    }

    impl<'a, T> Policy<'a, T>
    where
        T: Default,
    {
        pub fn new(
            name: &'a str,
        ) -> Self {
            let raw = r#"} fn raw() { " "#;
            fn helper(x: u8) -> u8 {
                x
            }
            Self { name, more: T::default() }
        }

        pub async unsafe fn run(&self) {}
    }

    impl<T> Waits for Policy<'_, T> {
        const LONGEST: u64 = 1;
        type Out = ();
        fn wait(&self) {}
    }

    type Short<'a> = Policy<'a>;
}

pub const fn plain() -> u8 { b'\'' }
extern "C" fn from_c(x: i32) -> i32 {
    x
}
'''
RUST_SYMBOLS = [
    ("mod", "retry", 1, 3, 61), ("const", "MOST", 2, 4, 4), ("static", "NAME", 2, 5, 5), ("static", "COUNT", 2, 6, 6), ("struct", "Policy", 2, 9, 12), ("struct", "Unit", 2, 14, 14), ("struct", "Pair", 2, 15, 15),
    ("enum", "Kind", 2, 17, 20), ("union", "Bits", 2, 22, 25), ("trait", "Waits", 2, 27, 35), ("const", "LONGEST", 3, 28, 28), ("type", "Out", 3, 29, 29), ("fn", "wait", 3, 30, 30), ("fn", "twice", 3, 31, 34),
    ("impl", "Policy", 2, 37, 52), ("fn", "new", 3, 41, 49), ("fn", "helper", 4, 45, 47), ("fn", "run", 3, 51, 51), ("impl", "Policy", 2, 54, 58), ("const", "LONGEST", 3, 55, 55), ("type", "Out", 3, 56, 56), ("fn", "wait", 3, 57, 57),
    ("type", "Short", 2, 60, 60), ("fn", "plain", 1, 63, 63), ("fn", "from_c", 1, 64, 66),
]

GO = '''package retry

/* type NotCode struct { */
// func Nor() {

type Policy struct {
	Name string `json:"name{"`
}

type Kind int

type Waits interface {
	Wait() error
}

type Pair[K comparable, V any] struct {
	key K
	val V
}

const text = `
func Raw() {
type Raw struct {
`

func New(name string) *Policy {
	f := func() { return }
	f()
	return &Policy{Name: "}"}
}

func (p *Policy) Wait() error {
	type local struct{}
	r := '{'
	_ = r
	return nil
}

func (p Pair[K, V]) Key() K { return p.key }

func Map[T, U any](
	xs []T,
	f func(T) U,
) []U {
	return nil
}

func init() {}
'''
GO_SYMBOLS = [
    ("type", "Policy", 1, 6, 8), ("type", "Kind", 1, 10, 10), ("type", "Waits", 1, 12, 14), ("type", "Pair", 1, 16, 19), ("func", "New", 1, 26, 30), ("method", "Wait", 1, 32, 37),
    ("method", "Key", 1, 39, 39), ("func", "Map", 1, 41, 46), ("func", "init", 1, 48, 48),
]

JAVA = '''package a;
/** class Not { } */
public class Policy<T extends Comparable<T>> {
    private final String text = """
        class Raw {
        void raw() {
        """;
    private char c = '{';

    public Policy(String name) {
        this.name = name;
    }

    @Override
    public String toString() {
        return "}";
    }

    public static <K, V> java.util.Map<K, V> of(
            K key,
            V value) {
        if (key == null) {
            return null;
        }
        return java.util.Map.of(key, value);
    }

    abstract int wait(long ms) throws InterruptedException;

    enum Kind {
        ONE,
        TWO;

        int code() {
            return 1;
        }
    }

    interface Waits {
        void pause();
    }

    record Pair(int a, int b) {
    }

    @interface Marked {
    }
}
'''
JAVA_SYMBOLS = [
    ("class", "Policy", 1, 3, 48), ("constructor", "Policy", 2, 10, 12), ("method", "toString", 2, 15, 17), ("method", "of", 2, 19, 26), ("method", "wait", 2, 28, 28), ("enum", "Kind", 2, 30, 37), ("method", "code", 3, 34, 36),
    ("interface", "Waits", 2, 39, 41), ("method", "pause", 3, 40, 40), ("record", "Pair", 2, 43, 44), ("@interface", "Marked", 2, 46, 47),
]

TYPESCRIPT = '''// class Not {
export abstract class Policy<T = {}> {
  private text = `class Raw { ${ `inner { ${1}` } method() {`;
  static pattern = /[{/}]{2}"/;

  constructor(private name: string) {
  }

  get size(): number {
    return '}'.length;
  }

  async wait<K>(
    ms: number,
    key: K,
  ): Promise<void> {
    if (ms > 0) {
      return;
    }
  }
}

export interface Waits {
  pause(ms: number): void;
}

export type Kind = "one" | "two";

export enum Level {
  Low,
  High,
}

namespace inner {
  export function deep(): string {
    return "{";
  }
}

export default function main(): void {
  function local() {}
}

export function* many() {
  yield 1;
}
'''
TYPESCRIPT_SYMBOLS = [
    ("class", "Policy", 1, 2, 21), ("method", "constructor", 2, 6, 7), ("method", "size", 2, 9, 11), ("method", "wait", 2, 13, 20), ("interface", "Waits", 1, 23, 25), ("type", "Kind", 1, 27, 27), ("enum", "Level", 1, 29, 32),
    ("namespace", "inner", 1, 34, 38), ("function", "deep", 2, 35, 37), ("function", "main", 1, 40, 42), ("function", "local", 2, 41, 41), ("function", "many", 1, 44, 46),
]

CPP = '''#define OPENS(x) struct x { \\
    int y;
// struct Not {
namespace retry {

struct Forward;

enum class Kind { One, Two };

template <typename T>
class Policy {
 public:
  explicit Policy(int n) : n_(n) {}
  ~Policy();
  virtual int wait(long ms) const = 0;
  int size() const { return 1'000; }

 private:
  const char* text = R"x(struct Raw { )" )x";
  char c = '{';
};

union Bits {
  int a;
  float b;
};

using Number = long;

int run(int a,
        int b) {
  if (a) {
    return b;
  }
  return 0;
}

}  // namespace retry
'''
CPP_SYMBOLS = [
    ("namespace", "retry", 1, 4, 38), ("enum", "Kind", 2, 8, 8), ("class", "Policy", 2, 11, 21), ("function", "Policy", 3, 13, 13), ("function", "~Policy", 3, 14, 14), ("method", "wait", 3, 15, 15), ("function", "size", 3, 16, 16),
    ("union", "Bits", 2, 23, 26), ("using", "Number", 2, 28, 28), ("function", "run", 2, 30, 36),
]

PYTHON = '''"""class Not: pass"""
import x


class Policy(Base):
    text = """
def raw():
"""

    @property
    def size(self):
        return 1

    async def wait(
        self,
        ms,
    ):
        def inner():
            return lambda: 0

        return inner

    class Kind:
        ONE = 1


@decorated
def main():
    pass


if x:
    def late(): pass
'''
PYTHON_SYMBOLS = [("class", "Policy", 1, 5, 24), ("def", "size", 2, 11, 12), ("def", "wait", 2, 14, 21), ("def", "inner", 3, 18, 19), ("class", "Kind", 2, 23, 24), ("def", "main", 1, 28, 29), ("def", "late", 1, 33, 33)]

CASES = {"rust": (RUST, RUST_SYMBOLS), "go": (GO, GO_SYMBOLS), "java": (JAVA, JAVA_SYMBOLS), "typescript": (TYPESCRIPT, TYPESCRIPT_SYMBOLS), "cpp": (CPP, CPP_SYMBOLS), "python": (PYTHON, PYTHON_SYMBOLS)}


@pytest.mark.parametrize("language", CASES)
def test_symbols(language):
    source, want = CASES[language]
    got = [(s.label, s.name, s.depth, s.start_line, s.end_line) for s in outline(source, language)]
    assert [x for x in got if x not in want] == [x for x in want if x not in got] == []
    assert got == want


@pytest.mark.parametrize("language", [x for x in CASES if x != "python"])
def test_blanked_code_keeps_its_lines(language):
    source = CASES[language][0]
    bare = bare_code(source, language)
    assert len(bare) == len(source) and [len(x) for x in bare.split("\n")] == [len(x) for x in source.split("\n")]
    assert bare.count("{") == bare.count("}")
    # what is cut short is no error
    for k in range(0, len(source), 7):
        assert len(bare_code(source[:k], language)) == k


def test_files_are_dealt_to_tasks_by_path(spark):
    files = spark.createDataFrame([(f"{k}.go", f"func F{k}() {{}}\n") for k in range(600)], "rel string, text string").coalesce(1)
    found = symbols(files)
    assert "RepartitionByExpression [rel" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.name for r in found.collect()) == sorted(f"F{k}" for k in range(600))


def test_names_do_not_stay_in_memory():
    gc.collect()
    tracemalloc.start()
    for k in range(3000):
        assert python_symbols(f"def name_of_{k}(argument_{k}):\n    return argument_{k}.field_{k}\n")[0].name == f"name_of_{k}"
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 100_000


@pytest.mark.parametrize(
    "source, names",
    [
        ("class \\\n  Ab:\n  async \\\n  def foo(self): pass\n", ["Ab", "foo"]), ("x = '\\N{DASH}'\nclass Cd:\n  x = '\\xZZ'\n", ["Cd"]), ("x = '\\N{EM DASH}'\nif x:\n  def aaa(): pass\n", ["aaa"]),
        ("def ﬁx(): pass\ndef éab(): pass\n", ["fix", "éab"]), ("match xx:\n  case yy:\n    def in_case(): pass\n", ["in_case"]), ("x = rb'q', f'{ab!r:>{cd}}'\r\nclass Ef[TT]: pass\r\n", ["Ef"]), ("type Gh = int\ndef aa[TT](): pass\n", ["aa"]),
    ],
)
def test_names_are_those_of_the_source(source, names):
    assert [s.name for s in python_symbols(source)] == names
