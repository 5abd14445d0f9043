"""Small tables with known metrics.

Fixed values: the rows are those that the golden metrics of the tests belong to.
"""


def numeric(spark):
    rows = [("1", 1, 0, 0, None), ("2", 2, 0, 0, None), ("3", 3, 0, 0, None), ("4", 4, 5, 4, 5), ("5", 5, 6, 6, 6), ("6", 6, 7, 7, 7)]
    return spark.createDataFrame(rows, "item string, att1 int, att2 int, att3 int, attNull int")


def full(spark):
    return spark.createDataFrame([("1", "a", "c"), ("2", "a", "c"), ("3", "a", "c"), ("4", "b", "d")], "item string, att1 string, att2 string")


def incomplete(spark):
    return spark.createDataFrame([("1", "a", "f"), ("2", "b", "d"), ("3", "a", None), ("4", "a", "f"), ("5", "b", None), ("6", "a", "f")], "item string, att1 string, att2 string")


def lengths(spark):
    rows = [("1", "a", "f", 1, 1), ("22", "b", "d", 2, None), ("333", "a", None, 3, 3), ("4444", "a", "f", 4, 4), ("55555", "b", None, 5, None), ("666666", "a", "f", 6, 6)]
    return spark.createDataFrame(rows, "item string, att1 string, att2 string, val1 int, val2 int")


def unique(spark):
    rows = [("1", "0", "3", "1", "5", "0"), ("2", "0", "3", "2", "6", "0"), ("3", "0", "3", None, "7", "0"), ("4", "5", None, "3", "0", "4"), ("5", "6", None, "4", "0", "5"), ("6", "7", None, "5", "0", "6")]
    return spark.createDataFrame(rows, "uniq string, nonUnique string, nonUniqueWithNulls string, uniqueWithNulls string, onlyUniqueWithOther string, halfUnique string")


def distinct(spark):
    return spark.createDataFrame([("a", None), ("a", None), (None, "x"), ("b", "x"), ("b", "x"), ("c", "y")], "att1 string, att2 string")


def all_null(spark):
    return spark.createDataFrame([(None, None, None, float(i)) for i in range(1, 9)], "s string, n1 double, n2 double, n3 double")


def empty(spark):
    return spark.createDataFrame([], "column1 string, column2 double")
