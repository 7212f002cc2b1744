"""Declarations, calls and imports of small sources in every language."""

import pytest

from strataloom.sources.extract import extracted_edges, extracted_symbols, rows_of

SOURCES = {
    "python": "import os\n\ndef cook(dish):\n    print(dish)\n\nclass Kitchen:\n    @cached\n    def serve(self, dish):\n        cook(dish)\n",
    "typescript": "import { taste, salt as s } from 'pantry';\nimport * as pots from 'pots';\nfunction cook(dish: string): void {\n  taste(dish, '(');\n}\nconst boil = (x: string) => cook(x);\nclass Kitchen<T> extends Room {\n  private n = 1;\n  serve(dish: string): void {\n    cook(dish); this.clean(`${dish}`);\n  }\n  async clean<T>(x: T): Promise<void> { if (x) { s(x) } }\n}\n",
    "javascript": "import taste from 'pantry';\nfunction cook(dish) {\n  console.log(dish);\n}\nclass Kitchen { serve(dish) { cook(dish); } }\n",
    "rust": "use pantry::{Salt, Oil as Fat};\nfn cook(dish: &str) {\n  println!(\"{}\", dish); // cook(1)\n}\nstruct Kitchen;\nimpl Kitchen {\n  fn serve<'a>(&self, dish: &'a str) -> u8 {\n    cook(dish); self.clean(); Vec::new()\n  }\n}\nimpl Clean for Yard { fn sweep(&self) { cook(\"}\") } }\n",
    "go": "package main\nimport (\n \"fmt\"\n \"a/b/pantry\"\n)\ntype Kitchen struct { x int }\nfunc cook(dish string) {\n fmt.Println(dish)\n}\nfunc (k *Kitchen) serve(dish string) string {\n cook(dish)\n return pantry.Taste(dish)\n}\n",
    "java": "package a;\nimport java.util.List;\n@Deprecated\npublic class Kitchen {\n  static void cook(String d) throws IOException { System.out.println(d); }\n  @Override\n  public List<String> serve(String d) { cook(d); return new Plate(d); }\n}\ninterface Guest { int count(); }\n",
    "csharp": "using System.Text;\nnamespace N {\n class Kitchen : Room {\n  void cook(string d) { Console.WriteLine(d); }\n  public void serve(string d) => cook(d);\n  int Pots { get; set; }\n }\n struct Plate { }\n}\n",
    "cpp": "#include <vector>\n#include \"pantry/salt.h\"\nvoid cook(const std::string& d) {\n  print(d);\n}\nclass Kitchen {\n public:\n  void serve(std::string d) { cook(d); }\n  int far(int);\n};\nint Kitchen::far(int x) const {\n  return x > 1 ? cook(x) : obj->go(x);\n}\n",
    "php": "<?php\nuse App\\Pantry\\Salt;\nfunction cook($d) {\n echo $d; strlen($d);\n}\nclass Kitchen {\n  public function serve($d) { cook($d); $this->clean($d); Yard::sweep(); }\n}\n",
    "vue": "<template><p>cook(1)</p></template>\n<script setup lang=\"ts\">\nimport { ref } from 'vue'\nfunction cook(d: string) { ref(d) }\nclass Kitchen { serve(d) { cook(d) } }\n</script>\n<style>p{}</style>\n",
}
IMPORTS = {"python": {"os"}, "typescript": {"taste", "salt", "pots"}, "javascript": {"taste"}, "rust": {"Salt", "Oil"}, "go": {"fmt", "pantry"}, "java": {"List"}, "csharp": {"Text"}, "cpp": {"vector", "pantry/salt.h"}, "php": {"Salt"}, "vue": {"ref"}}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_declarations_calls_and_imports(language):
    symbols, edges = rows_of(SOURCES[language], language)
    by_name = {s[2]: s for s in symbols}
    assert len(by_name) == len(symbols) and symbols[0][2:4] == ("<module>", "module")
    inside = language in ("java", "csharp")
    assert by_name["cook"][3] == ("method" if inside else "function") and by_name["serve"][3] == "method"
    assert by_name["Kitchen"][3] == ("struct" if language in ("rust", "go") else "class") and by_name["serve"][1] == by_name["Kitchen"][0]
    calls = {(symbols[o][2], n) for o, n, k, _, _ in edges if k == "calls"}
    assert ("serve", "cook") in calls and ("<module>", "cook") not in calls
    assert {n for _, n, k, _, _ in edges if k == "imports"} == IMPORTS[language]
    assert all(1 <= s[4] <= s[5] <= SOURCES[language].count("\n") + 1 for s in symbols)


def test_finer_points():
    rust, edges = rows_of(SOURCES["rust"], "rust")
    names = {s[2]: s for s in rust}
    assert ("cook", "println", "references") in {(rust[o][2], n, k) for o, n, k, _, _ in edges}
    assert names["Kitchen"][4:6] == (5, 5) and names["sweep"][1] == names["Yard"][0] and names["Yard"][3] == "impl"
    assert ("boil", "cook") in {(ts[o][2], n) for ts, es in [rows_of(SOURCES["typescript"], "typescript")] for o, n, k, _, _ in es if k == "calls"}
    java = {s[2]: s for s in rows_of(SOURCES["java"], "java")[0]}
    assert java["Kitchen"][7] == ",Deprecated," and java["serve"][7] == ",Override," and java["count"][1] == java["Guest"][0]
    cpp = {s[2]: s for s in rows_of(SOURCES["cpp"], "cpp")[0]}
    assert cpp["far"][1] == cpp["Kitchen"][0] and cpp["far"][4:6] == (11, 13) and cpp["cook"][6] == "(const std::string &d)"


@pytest.mark.parametrize("language", sorted(set(SOURCES) - {"python"}))
def test_broken_sources_end(language):
    text = SOURCES[language]
    for cut in range(0, len(text), 7):
        rows_of(text[cut:], language), rows_of(text[:cut], language)
    for junk in ("{" * 3000, "}" * 3000, "(" * 3000, "f(" * 1500, "'" * 3001, "class " * 2000, ""):
        assert rows_of(junk, language)[0]


def test_extraction_in_spark(spark):
    files = spark.createDataFrame([(f"src/a.{k}", t, k) for k, t in SOURCES.items()] + [("x.txt", "cook()", "text"), ("n.go", None, "go")], "path string, text string, language string")
    symbols, edges = extracted_symbols(files), extracted_edges(files)
    assert {r.language for r in symbols.collect()} == set(SOURCES)
    callers = symbols.join(edges.where("kind = 'calls' and to_name = 'cook'"), symbols["id"] == edges["from_id"]).where("name = 'serve'")
    assert {r.language for r in callers.collect()} == set(SOURCES)
    assert symbols.groupBy("id").count().where("count > 1").count() == 0
