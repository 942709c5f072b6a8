"""Functions under SQL names: equal to the column builders, planned without Python, and refused policies."""

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import answers as A
from tracequarry.functions import registers as R
from tracequarry.functions import text as T
from tracequarry.functions.sql import register_sql_functions
from tracequarry.sources.fixtures import tagged_traces, traces

SF = "/root/testdata/sf0.001"
ODD = ["", None, " <ans> 4 </ans>", "verify( 5 == 5 ) → ✓ 7", "verify(5 == 6) → ✓", "</think> True.", "<REG:BYPASS> 3 </reg:bypass>", "∴ ans = x|9", "<reg:plan> </reg:plan>", "<reg:deduce>a</reg:deduce> ans = 5", "a\n\tb →→ ∞x"]


def test_equal_to_columns(spark):
    register_sql_functions(spark)
    names = register_sql_functions(spark)
    assert {"estimate_tokens", "parse_registers", "extract_answer"} <= set(names)
    rows = traces(spark, SF).select("completion").limit(300).union(tagged_traces(spark, SF).select("completion").limit(300)).union(spark.createDataFrame([(t,) for t in ODD], "completion string")).cache()
    c = F.col("completion")
    parsed = R.parse_registers(c)
    columns = rows.select(A.grammar(c).alias("g"), A.lenient(c).alias("l"), T.token_estimate(c).alias("n"), *(parsed[f].alias(f) for f in ("register_type", "plan", "deduction", "verification", "scratchpad", "bypass", "intent")))
    called = spark.sql("SELECT extract_answer(completion, 'grammar') AS g, extract_answer(completion, 'lenient') AS l, estimate_tokens(completion) AS n, parse_registers(strip_blanks(completion)) AS p FROM {rows}", rows=rows).select("g", "l", "n", "p.*")
    assert columns.exceptAll(called).count() == 0 == called.exceptAll(columns).count()
    plan = called._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.sql("SELECT compression_ratio(100, 40), compression_ratio(0, 1), compression_ratio(10, 20)").first()[:] == (0.6, 0.0, 0.0)
    with pytest.raises(Exception, match="no such policy"):
        spark.sql("SELECT extract_answer(t, p) FROM VALUES ('x', 'none') AS v(t, p)").collect()
