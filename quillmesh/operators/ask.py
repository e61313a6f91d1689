"""Answering questions: the steps that ask a model, and the whole way from a question to a checked answer.

``complete`` is a column function from a prompt to a reply, such as
``functions.models.completion`` makes of a client, and ``embed`` one from a text
to a vector. Each model step is one column of one table, so a batch of questions
is a batch of calls; what a model said is stored before it is read twice. A
reply that is missing or can't be read leaves things as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.text import evidence_terms
from quillmesh.operators import bm25, chat, context, evidence, retrieval, safety
from quillmesh.operators.messages import picked
from quillmesh.workspace import stored

#: What prompts show: turns and their characters, characters of a readme, results and their characters.
TURNS, TURN_CHARS, README_CHARS, SHOWN, SHOWN_CHARS = 4, 200, 600, 3, 100
#: Directories and files that a model chooses from, how many it may choose, and characters of their summaries.
DIRS, DIR_PICKS, FILES, FILE_PICKS, SUMMARY_CHARS = 20, 3, 25, 4, 120
#: Characters from which a corrected answer takes the place of the first one.
LEAST_ANSWER = 20


def _joined(order, line: Column, most: int, separator: str = "\n") -> Column:
    """The first ``most`` lines of a group by ``order``."""
    rows = F.slice(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), 1, most)
    return F.array_join(F.transform(rows, lambda x: x["line"]), separator)


def query_variants(queries: DataFrame, complete, turns: DataFrame | None = None, readme: Column | None = None) -> DataFrame:
    """``query_id, variant, text``: the query as variant 0 and up to three phrasings that a model adds.

    queries: ``query_id, text``; turns: ``query_id, turn, role, text`` of the conversation before.
    """
    query = chat.trimmed(F.coalesce("text", F.lit("")))
    rows = queries.select("query_id", query.alias("text"))
    if turns is not None:
        last = turns.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("turn")))).where(F.col("n") <= TURNS)
        said = last.groupBy("query_id").agg(_joined(["turn"], F.concat("role", F.lit(": "), F.substring("text", 1, TURN_CHARS)), TURNS).alias("said"))
        rows = rows.join(said, "query_id", "left")
    else:
        rows = rows.withColumn("said", F.lit(None).cast("string"))
    prompt = F.concat(
        F.lit("Phrase this search over source code in three other ways, one a line: spell abbreviations out, use synonyms and technical names, and replace pronouns by what the conversation is about.\nSearch: "), "text",
        F.coalesce(F.concat(F.lit("\nConversation:\n"), "said"), F.lit("")), F.coalesce(F.concat(F.lit("\nWords of the project:\n"), F.substring(readme, 1, README_CHARS)), F.lit("")) if readme is not None else F.lit(""),
    )
    replies = stored(rows.select("query_id", "text", complete(prompt).alias("reply")), "variants")
    return replies.select("query_id", F.posexplode(chat.variant_lines(F.col("reply"), F.col("text"))).alias("variant", "text"))


def refined_queries(queries: DataFrame, results: DataFrame, complete) -> DataFrame:
    """``query_id, text``: a better search for every query whose results are weak, where the model has one.

    results: ``query_id, rank, file, code, score``.
    """
    weak = retrieval.needs_refinement(results, queries).where("weak").select("query_id")
    shown = results.groupBy("query_id").agg(_joined(["rank"], F.concat("file", F.lit(": "), F.substring("code", 1, SHOWN_CHARS)), SHOWN).alias("shown"))
    rows = queries.join(weak, "query_id").join(shown, "query_id", "left")
    prompt = F.concat(F.lit("A code search has found little. Give one better search with names of functions, files or symbols, or say SUFFICIENT if this answers it.\nSearch: "), "text", F.lit("\nFound:\n"), F.coalesce("shown", F.lit("(nothing)")))
    replies = stored(rows.select("query_id", complete(prompt).alias("reply")), "refined")
    return replies.select("query_id", chat.refined_query(F.col("reply")).alias("text")).where("text is not null")


def _choice(rows: DataFrame, keys: list[str], what: str, shown: int, most: int, complete) -> DataFrame:
    """``query_id, repo, path`` that a model picks of the first ``shown`` paths. rows: ``keys, text, ord, path, summary``."""
    by = Window.partitionBy(*keys).orderBy("ord", "path")
    first = rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= shown)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "path", F.lit(" - "), F.substring(F.coalesce("summary", F.lit("")), 1, SUMMARY_CHARS))
    lists = first.groupBy(*keys).agg(F.first("text").alias("text"), _joined(["n"], line, shown).alias("lines"), F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("paths"))
    prompt = F.concat(F.lit("Question about a repository: "), "text", F.lit(f"\nWhich {what} hold the answer? Reply with a JSON array of at most {most} of these paths.\n"), "lines")
    replies = stored(lists.select(*keys, "paths", complete(prompt).alias("reply")), "picks")
    return replies.select(*keys, F.explode(F.slice(picked(F.col("reply"), F.col("paths"), most), 1, most)).alias("path"))


def page_index_picks(nodes: DataFrame, queries: DataFrame, complete) -> DataFrame:
    """``query_id, repo, path``: the files that a model reaches through the directories that it picks first.

    nodes: as ``summaries.page_index`` makes them; queries: ``query_id, repo, text``.
    """
    dirs = nodes.where("level = 1").select("repo", "path", "summary", "ord").join(queries, "repo")
    chosen = _choice(dirs, ["query_id", "repo"], "directories", DIRS, DIR_PICKS, complete).withColumnRenamed("path", "parent")
    files = nodes.where("level = 2").select("repo", "path", "parent", "summary", "ord").join(chosen, ["repo", "parent"]).join(queries.select("query_id", "text"), "query_id")
    return _choice(files, ["query_id", "repo"], "files", FILES, FILE_PICKS, complete)


def verified_answers(answers: DataFrame, chunks: DataFrame, embed, complete, dims: int = 64, index: bm25.Bm25Index | None = None) -> DataFrame:
    """``query_id, answer, claims, changed``: answers after their first claims were held against the corpus.

    answers: ``query_id, question, answer``; chunks: ``id, file, text, v``. An
    answer without claims or evidence stays, as does one whose correction is
    missing, the same, or short.
    """
    asked = F.concat(F.lit("List the factual claims that this answer makes about the code, numbered, one a line.\n"), F.coalesce("answer", F.lit("")))
    listed = stored(answers.select("query_id", "question", "answer", chat.claims(complete(asked)).alias("claims")), "claims")
    proof = retrieval.claim_evidence(listed.select(F.col("query_id").alias("answer_id"), "claims"), chunks, embed, dims=dims, index=index)
    lines = proof.groupBy(F.col("answer_id").alias("query_id")).agg(_joined(["claim"], F.concat(F.lit("Claim: "), "claim", F.lit("\n"), "evidence"), 3, "\n\n").alias("proof"))
    prompt = F.concat(F.lit("Correct this answer where the evidence from the code contradicts it, and reply with the whole answer.\nQuestion: "), "question", F.lit("\nAnswer: "), "answer", F.lit("\nEvidence:\n"), "proof")
    revised = stored(listed.join(lines, "query_id", "left").withColumn("reply", F.when(F.col("proof").isNotNull(), complete(prompt))), "revised")
    changed = F.coalesce((F.length("reply") > LEAST_ANSWER) & (F.col("reply") != F.col("answer")), F.lit(False))
    return revised.select("query_id", F.when(changed, F.col("reply")).otherwise(F.col("answer")).alias("answer"), F.size("claims").alias("claims"), changed.alias("changed"))


def plain_variants(queries: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """``query_id, variant, text`` without a model: the query, after a follow-up with terms of the turns before, and a variant of its code symbols.

    queries: ``query_id, text``; turns: ``query_id, turn, role, text`` of the conversation before.
    """
    text = queries.select("query_id", chat.trimmed(F.coalesce("text", F.lit(""))).alias("text"))
    if turns is not None:
        own = turns.select(F.col("query_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        asked = text.select(F.col("query_id").alias("conv_id"), F.lit((1 << 62) + 1).alias("turn"), F.lit("user").alias("role"), "text")
        text = chat.contextual_queries(own.unionByName(asked)).select(F.col("conv_id").alias("query_id"), F.col("query").alias("text"))
    return text.select("query_id", F.posexplode(chat.expanded(F.col("text"))).alias("variant", "text"))


def retrieved(chunks: DataFrame, queries: DataFrame, embed, complete=None, turns: DataFrame | None = None, limit: int = 5, most: int = 8, dims: int = 64, edges: DataFrame | None = None, index: bm25.Bm25Index | None = None) -> DataFrame:
    """``query_id, id, score, file, name, node_type, code, rank``: what a question finds before anything is asked about it.

    With a model the query is searched in the phrasings that it adds, and weak
    results are searched once more; without one in those of ``plain_variants``.
    Every search fuses its variants and ranks them by preference, so the scores
    that are merged, and judged as weak, are on one scale. A question for an
    overview gets the usual introductory files behind its results.
    """
    index = index or bm25.build_index(chunks, "id", "text")
    variants = plain_variants(queries, turns) if complete is None else query_variants(queries, complete, turns)
    search = lambda v: retrieval.multipath_search(chunks, v.withColumn("q", embed(F.col("text"))), limit, dims=dims, edges=edges, index=index)
    texts = chunks.select("id", "file", "name", "node_type", F.col("text").alias("code"))
    # some rows a query, stored so that texts aren't shuffled to join them
    found = stored(stored(search(variants), "searched").join(texts, "id"), "found")
    results = found.select("query_id", "id", "score")
    if complete is not None:
        better = stored(refined_queries(queries, found, complete), "better")
        merged = retrieval.merge_refined(found.join(better.select("query_id"), "query_id", "left_semi"), search(better.withColumn("variant", F.lit(0))), most)
        results = found.join(better.select("query_id"), "query_id", "left_anti").select(results.columns).unionByName(merged.select(results.columns))
    wanted = queries.where(chat.matches_any(F.coalesce("text", F.lit("")), chat.OVERVIEW)).select("query_id")
    files = chunks.select("id", "file", (F.col("ord") if "ord" in chunks.columns else F.col("id")).alias("ord"))
    every = retrieval.inject_baseline(results.join(files.select("id", "file"), "id").select("query_id", "id", "file", "score"), wanted, files)
    order = [F.round("score", 9).desc(), F.col("id")]
    ranked = every.drop("file").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return stored(ranked, "merged").join(texts, "id")


def ask(chunks: DataFrame, queries: DataFrame, embed, complete, turns: DataFrame | None = None, limit: int = 5, limits: dict = context.LIMITS["mlc"], dims: int = 64, strict: bool = True, verify: bool = True, index: bm25.Bm25Index | None = None, edges: DataFrame | None = None, expand: bool = True) -> DataFrame:
    """One row per query: ``query_id, answer, blocked, level, matched, missing, stage, citations, claims, changed``.

    chunks: ``id, file, name, node_type, text, v`` and, where they have them,
    ``ord`` in the file and ``definitions`` of the file; queries: ``query_id,
    text``; edges: ``id, neighbour`` of the code's graph.
    Results are those of ``retrieved``, with phrasings of the model if
    ``expand``. They are scanned for instructions and made safe, and what fits
    the budget goes to the model. A question for a fact with hardly any evidence
    is ``blocked`` and has no answer, as has, with ``strict``, one whose results
    give orders. Introductory files are evidence for no question and aren't
    cited. The answer's claims are checked.
    """
    index = index or bm25.build_index(chunks, "id", "text")
    results = stored(retrieved(chunks, queries, embed, complete if expand else None, turns, limit, dims=dims, edges=edges, index=index), "ranked")
    scanned = stored(safety.scan(results), "scanned")
    safe = stored(safety.safe_results(results, scanned), "safe")
    asked = queries.select("query_id", F.col("text").alias("question"), evidence_terms(F.col("text")).alias("terms"))
    covered = evidence.coverage(asked.select("query_id", "terms"), results.where("score > 0"))
    unsafe = F.coalesce(F.col("strict"), F.lit(False)) if strict else F.lit(False)
    judged = asked.join(covered.select("query_id", "matched", "missing", "best"), "query_id", "left").join(scanned.select("query_id", "level", "strict"), "query_id", "left").join(context.assemble(safe, limits).select("query_id", "context", "stage"), "query_id", "left")
    judged = judged.withColumn("blocked", F.coalesce(evidence.blocked(judged, chat.matches_any(F.col("question"), chat.FACT)), F.lit(False)) | unsafe)
    prompt = F.concat(F.lit("Answer from these parts of the code and name their files.\n"), F.coalesce("context", F.lit("(nothing was found)")), F.lit("\n\nQuestion: "), "question")
    answered = stored(judged.withColumn("answer", F.when(~F.col("blocked"), complete(prompt))), "answers")
    cited = evidence.grounded(safe.where("cited and score > 0"), asked.select("query_id", "terms")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "file"))), lambda x: F.struct(x["id"], x["file"])).alias("citations"))
    out = answered.join(cited, "query_id", "left")
    if verify:
        checked = verified_answers(answered.where("answer is not null").select("query_id", "question", "answer"), chunks, embed, complete, dims, index)
        out = out.join(checked.withColumnRenamed("answer", "checked"), "query_id", "left").withColumn("answer", F.coalesce("checked", "answer"))
    else:
        out = out.withColumns({"claims": F.lit(0), "changed": F.lit(False)})
    return out.select("query_id", "answer", "blocked", "level", "matched", "missing", "stage", "citations", F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("changed", F.lit(False)).alias("changed"))
