"""Small inputs: the driver's tables where they are, else a few rows of the same kind."""

import os

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    if os.path.isdir(FOLDER):
        return spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(20 + i % 60)), "en", f"src{i % 5}", 0) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark):
    if os.path.isdir(FOLDER):
        return spark.read.parquet(f"{FOLDER}/labels.parquet")
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")


def pages(spark):
    if os.path.isdir(FOLDER):
        return spark.read.parquet(f"{FOLDER}/pages.parquet")
    page = "<html><body><nav>m</nav><article><h1>T{0}</h1><p>Text of {0}.</p></article><footer>f</footer></body></html>"
    return spark.createDataFrame([(i, f"https://a{i}.example.org/en/{i}", page.format(i)) for i in range(20)], "page_id long, url string, html string")


def rows_of(spark, found, given):
    """Urls, pages and what was found of each, matched by url."""
    pages = {r["url"]: r["html"] for r in given.collect()}
    return [(r["url"], pages[r["url"]], r["found"]) for r in found.collect()]


def folder(spark, path, **tables):
    """A folder with Parquet tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
