"""The inside of a module: its files, its folder, and what stands under its block in the syntax tree."""

from pyspark.sql import functions as F

from meshlight.operators import resolution as V
from meshlight.sources import extract as X

TEXTS = {
    "app/utils.py": "def clean(x):\n    return x\n",
    "app/utils/deep/more.py": "def more(x):\n    return x\n",
    "app/lib.rs": "mod utils {\n    fn inner() {}\n    mod sub {\n        fn below() {}\n    }\n}\nfn beside() {}\n",
    "other/lib.rs": "mod utils {\n    fn foreign() {}\n}\nmod app {\n    mod utils {\n        fn nested() {}\n    }\n    fn outside() {}\n}\n",
    "q/xutils/a.py": "def no(x):\n    return x\n",
    "q/b.rs": "fn utils() {} // mod\n",
}


def test_blocks_and_folders_of_a_module_belong_to_it(spark):
    files = spark.createDataFrame([*TEXTS.items()], "path string, source string")
    found = lambda label: sorted(r.name for r in V.module_interior(X.extract(files), label).collect())
    assert found("app::utils") == ["below", "clean", "inner", "more", "nested", "sub"]  # clean alone before
    assert found("utils") == ["below", "clean", "foreign", "inner", "more", "nested", "sub"]
    assert found("utils.sub") == ["below"] and found("none") == []


def test_files_that_may_hold_a_module_give_all_of_its_rows(spark):
    files = spark.createDataFrame([*TEXTS.items()], "path string, source string")
    for label in ("app::utils", "utils.sub", "app"):
        kept = files.where(V.may_hold_module(F.col("path"), F.col("source"), label))
        assert sorted(V.module_interior(X.extract(kept), label).select("id").collect()) == sorted(V.module_interior(X.extract(files), label).select("id").collect())
    assert files.where(V.may_hold_module(F.col("path"), F.col("source"), "app::utils")).count() == 5
