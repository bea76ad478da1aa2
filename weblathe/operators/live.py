"""A mirror that is kept up to date part by part: after each run, wave of a crawl or batch of a stream, its files are those of one run over everything so far.

Documents are kept as they were received. What a document's file looks like depends on which of its links lead to mirrored documents or to redirects, so a
part changes the files of its own documents and of those that link to something that the part made known. A reverse index, (target, page), in
buckets by target, tells which these are; only they are read and converted again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblathe.functions import text as T
from weblathe.functions import weburl as U
from weblathe.operators import extract, mirror
from weblathe.operators.store import kept
from weblathe.sources import state
from weblathe.sources.files import compose, delete_files, write_files, write_parts

CONVERTIBLE = ("text/html", "text/css")


def received(saved: DataFrame, responses: DataFrame, filename: Callable[[Column], Column] | None = None, now: str | None = None) -> DataFrame:
    """What the log's saved links were received with, as rows of documents. filename: of the mime type, and of a link's columns. now: the time in UTC."""
    mime = T.mime(F.try_element_at("headers", F.lit("content-type")))
    name = filename(mime) if filename else mirror.default_filename(F.col("netloc"), F.col("path"), F.col("query"), mime)
    get = lambda k: F.try_element_at("headers", F.lit(k))
    columns = [F.col("r")[c].alias(c) for c in responses.columns if c in ("final_url", "headers", "content")]
    rows = saved.join(responses.select(F.col("url").alias("r_url"), F.struct("*").alias("r")), F.col("url") == F.col("r_url")).select(*saved.columns, *columns)
    files = kept(
        rows.select(
            "url", "original_url", name.alias("filename"), mime.alias("mimetype"), extract.charset_of(F.col("content"), F.col("headers")).alias("encoding"), get("etag").alias("etag"),
            get("last-modified").alias("last_modified"), T.http_date(get("expires")).alias("expires"), F.lit(now).cast("timestamp_ntz").alias("received"), F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("digest"), *[c for c in rows.columns if c in ("final_url", "headers", "content")],
        )
    )
    link = F.struct(F.col("absolute").alias("url"), "inline", "tag", "do_not_follow", "source")
    links = extract.links_of(files).groupBy(F.col("from_url").alias("url")).agg(F.sort_array(F.collect_list(F.struct("n", link.alias("l")))).alias("l"))
    return files.join(links, "url", "left").withColumn("links", F.transform("l", lambda x: x["l"])).drop("l", "headers", "final_url")


@dataclass
class LiveMirror:
    """The mirror in a folder. since: the first part of this run, which decides what counts as met. convert: whether links are converted. backups: whether documents that
    conversion changes are also kept as files, as they were received."""

    spark: SparkSession
    path: str
    since: int = 0
    convert: bool = True
    backups: bool = False

    def _log(self, name: str) -> DataFrame:
        return state.log(self.spark, self.path, name)

    def met(self) -> DataFrame:
        """(url, filename) of what this run has met so far."""
        return self._log("encountered").filter(F.col("part") >= self.since).groupBy("url").agg(F.min("filename").alias("filename"))

    def publish(self, part: int, files: DataFrame, again: DataFrame, redirects: DataFrame, update: bool = True) -> DataFrame:
        """Adds received files, urls met again without being loaded (url), and redirects (url, code, target_url), as a part. Returns (url) of the documents whose files were written.

        Without update, files are written as they were received, for refresh() to convert later.
        """
        spark, path = self.spark, self.path
        again = kept(mirror.encounter(again, state.read(spark, path, "stored")))
        state.append(files.withColumn("bucket", state.bucket(F.col("url"))), path, "documents", part)
        own = self._log("documents").filter(F.col("part") == part)
        state.append(own.select("url", "filename").unionByName(again.select("url", "filename")).distinct(), path, "encountered", part)
        state.append(redirects, path, "redirects", part)
        targets = own.select(F.col("url").alias("used_by"), F.explode("links").alias("l")).select("used_by", U.canonical(U.normalise(F.col("l.url"))).alias("url"))
        state.append(targets.filter("url IS NOT NULL").distinct().withColumn("bucket", state.bucket(F.col("url"))), path, "usage", part)
        if not update or not self.convert:
            write_files(own.select("filename", "content"), path).count()
            return own.select("url").distinct()
        changed = kept(self._changed(part))
        self._write(changed, part)
        return changed

    def _changed(self, part: int) -> DataFrame:
        """(url) of what a part changes: what it met, and pages met earlier that link to it, to a redirect of it, or to a redirect that leads to it."""
        fresh = self._log("encountered").filter(F.col("part") == part).select("url").distinct()
        moved = self._log("redirects")
        touched = fresh.unionByName(moved.filter(F.col("part") == part).select("url")).unionByName(moved.join(fresh.select(F.col("url").alias("target_url")), "target_url", "left_semi").select("url")).distinct()
        touched = touched.withColumn("bucket", state.bucket(F.col("url")))
        linking = self._log("usage").join(touched, ["bucket", "url"], "left_semi").select(F.col("used_by").alias("url")).distinct()
        return linking.join(self.met().select("url"), "url", "left_semi").unionByName(fresh).distinct()

    def refresh(self) -> DataFrame:
        """Converts all that this run has met. Returns (url) of it."""
        every = kept(self.met().select("url"))
        if self.convert:
            self._write(every, state.next_part(self.spark, self.path) - 1)
        return every

    def _write(self, urls: DataFrame, part: int) -> None:
        made = self.converted(urls)
        if self.backups:
            made = kept(made)
            known = self._log("backups").filter(F.col("part") < part).select("filename", "digest").distinct()
            lost = made.filter("changed").join(known, ["filename", "digest"], "left_anti")  # each content of a file is kept once
            state.append(lost, self.path, "backups", part)
            write_files(lost.select(F.concat(F.lit(".backups/"), F.col("filename")).alias("filename"), "content"), self.path).count()
        write_files(made.select("filename", F.col("new").alias("content")), self.path).count()

    def converted(self, urls: DataFrame) -> DataFrame:
        """url, filename, digest, content, new (bytes with converted links) and changed of the last documents of urls that this run has met."""
        met = self.met()
        every, wanted = self._log("documents"), urls.withColumn("bucket", state.bucket(F.col("url")))
        last = every.join(wanted, ["bucket", "url"], "left_semi").groupBy("bucket", "url").agg(F.max("part").alias("part"))
        docs = every.join(last, ["bucket", "url", "part"], "left_semi").drop("filename", "bucket", "part", "links").join(met, "url")
        docs = kept(docs)
        rows = docs.filter(F.col("mimetype").isin(*CONVERTIBLE)).select(F.col("url").alias("from_url"), F.col("original_url").alias("at"), "mimetype", "encoding", "content", F.col("filename").alias("from_file"))
        raw = extract.extract_links(rows, url="at", mime="mimetype", charset="encoding").withColumn("normal", U.normalise(F.col("absolute")))
        raw = raw.withColumn("target", U.canonical(F.col("normal"))).withColumn("fragment", U.fragment(F.col("normal")))
        # every link of a stored document is known as a link
        new = mirror.link_targets(raw.select("from_url", "from_file", "n", "raw", "absolute", "target", "fragment"), met, state.read(self.spark, self.path, "redirects"), None)
        maps = new.filter("new IS NOT NULL").groupBy("from_url", "raw").agg(F.min("new").alias("new")).groupBy("from_url").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("changes"))
        both = docs.join(maps, F.col("url") == F.col("from_url"), "left")
        both = both.withColumn("new", extract.rewrite_documents(F.col("content"), F.col("mimetype"), F.col("encoding"), F.col("changes")))
        return both.select("url", "filename", "digest", "content", "new", (~F.col("content").eqNullSafe(F.col("new"))).alias("changed"))

    def prune(self, part: int) -> None:
        """Deletes the files of urls that this run didn't meet, and old files of those that it did."""
        stored = state.read(self.spark, self.path, "stored")
        gone = kept(mirror.prune(stored, self.met()))
        left = stored.join(gone.select("url", "filename"), ["url", "filename"], "left_anti").select("filename")
        delete_files(gone.select("filename").distinct().join(left, "filename", "left_anti"), self.path).count()  # a file may have got another url meanwhile
        state.append(gone, self.path, "deleted", part)

    def write_index(self) -> None:
        """index.html: an anchor per stored url, by file name. Ranges of names are written as parts, and one task puts these one after another."""
        names = state.read(self.spark, self.path, "stored").groupBy("url").agg(F.min("filename").alias("f"))
        line = F.concat(F.lit('<a href="'), F.col("f"), F.lit('">'), F.col("f"), F.lit("</a><br>"))
        ranges = names.repartitionByRange("f", "url").sortWithinPartitions("f", "url").select(F.spark_partition_id().alias("range"), line.alias("text"))
        parts = write_parts(ranges, self.path, ".state/index")
        compose(parts, self.path, ".state/index", "index.html")
