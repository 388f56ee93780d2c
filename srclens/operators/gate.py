"""The upload gate: checks per file, outcome per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.text import extension, is_blank, stored_name

# Limits of the gate.
MAX_FILE_BYTES = 5 * 1024 * 1024
ALLOWED_EXTENSIONS = ("php",)

# Transfer status code -> text, and the other rejection texts.
TRANSFER_ERRORS = {
    1: "Fichier trop volumineux",
    2: "Fichier trop volumineux",
    3: "Téléchargement partiel",
    4: "Aucun fichier téléchargé",
    6: "Répertoire temporaire manquant",
    7: "Erreur d'écriture",
    8: "Extension PHP bloquée",
}
UNKNOWN_TRANSFER_ERROR = "Erreur de téléchargement inconnue"
NAME_MISSING = "Nom de fichier manquant"
BAD_EXTENSION = "Extension de fichier non autorisée. Seuls les fichiers .php sont acceptés"
TOO_BIG = "Fichier trop volumineux (maximum 5MB)"

# Outcome codes of a batch and their messages.
VALIDATION_FAILED = ("UPLOAD_VALIDATION_FAILED", "Certains fichiers n'ont pas pu être téléchargés")
NO_VALID_FILES = ("NO_VALID_FILES", "Aucun fichier valide n'a été fourni")
NO_FILES = ("NO_FILES", "Aucun fichier n'a été fourni pour l'analyse")


def transfer_error(status: Column) -> Column:
    """Text for a failed transfer, null for status 0."""
    known = F.create_map(*[c for k, v in TRANSFER_ERRORS.items() for c in (F.lit(k), F.lit(v))])
    return F.when(status != 0, F.coalesce(F.try_element_at(known, status), F.lit(UNKNOWN_TRANSFER_ERROR)))


def rejection(status: Column, name: Column, size: Column) -> Column:
    """Why a file is refused, null if it is accepted; the first failing check wins."""
    allowed = F.lower(extension(name)).isin(*ALLOWED_EXTENSIONS)
    return F.coalesce(
        transfer_error(status),
        F.when(name.isNull() | is_blank(name), NAME_MISSING),
        F.when(~allowed, BAD_EXTENSION),
        F.when(size > MAX_FILE_BYTES, TOO_BIG),
    )


def validate_files(uploads: DataFrame) -> DataFrame:
    """``uploads`` plus ``error`` (null = accepted)."""
    return uploads.withColumn(
        "error", rejection(F.col("status"), F.col("original_name"), F.col("size")))


def validate_client(uploads: DataFrame) -> DataFrame:
    """The drop filter of the client: names ending in ``.php``, case-sensitive."""
    return uploads.where(F.endswith(F.col("original_name"), F.lit(".php")))


def rejects(uploads: DataFrame) -> DataFrame:
    """Rejected files as rows (a batch may reject any number of them)."""
    return validate_files(uploads).where(F.col("error").isNotNull())


def _outcome(total: Column, rejected: Column) -> list[Column]:
    accepted = total - rejected
    def pick(i: int) -> Column:
        return (F.when(total == 0, NO_FILES[i]).when(rejected > 0, VALIDATION_FAILED[i])
                .when(accepted == 0, NO_VALID_FILES[i]))

    return [
        ((rejected == 0) & (accepted > 0)).alias("success"),
        pick(0).alias("error_code"), pick(1).alias("message"),
        accepted.alias("accepted"), rejected.alias("rejected"), total.alias("total_files"),
    ]


def gate_batch(uploads: DataFrame, *batch: str) -> DataFrame:
    """Outcome per batch (no batch columns: the whole input is one batch).

    Only counts are aggregated, with partial sums per task, so one batch may
    hold any share of the rows; the rejected files themselves are ``rejects``.
    """
    checked = validate_files(uploads)
    counts = [F.count(F.lit(1)).alias("_total"),
              F.count_if(F.col("error").isNotNull()).alias("_rejected")]
    grouped = checked.groupBy(*batch).agg(*counts) if batch else checked.agg(*counts)
    return grouped.select(*batch, *_outcome(F.col("_total"), F.col("_rejected")))


def accepted_files(uploads: DataFrame, mode: str = "strict", *batch: str) -> DataFrame:
    """Files that go on to the analysis.

    ``per_row`` keeps every accepted file; ``strict`` keeps none of a batch in
    which any file was rejected.  The strict anti-join carries only the keys of
    failed batches; adaptive execution splits a hot batch on the file side.
    """
    checked = validate_files(uploads)
    good = checked.where(F.col("error").isNull()).drop("error")
    if mode == "per_row":
        return good
    if mode != "strict":
        raise ValueError(f"unknown mode: {mode}")
    bad = checked.where(F.col("error").isNotNull())
    if batch:
        failed = bad.select(*[F.col(b).alias(f"_bad_{b}") for b in batch]).distinct()
        same = F.lit(True)
        for b in batch:  # a null key is a batch like any other
            same = same & F.col(b).eqNullSafe(F.col(f"_bad_{b}"))
        return good.join(failed, same, "left_anti")
    any_bad = F.broadcast(bad.agg(F.count(F.lit(1)).alias("_bad")))  # one row
    return good.join(any_bad, F.col("_bad") == 0, "left_semi")


def manifest(uploads: DataFrame, mode: str = "strict", *batch: str, key: str = "upload_id") -> DataFrame:
    """Accepted files with their stored name and path, without analysis.

    ``key`` tells the uploads of a batch apart.
    """
    files = accepted_files(uploads, mode, *batch)
    name = stored_name(F.col("original_name"), F.col("unix_time"), *[F.col(b) for b in batch], F.col(key))
    return files.withColumn("stored_name", name).withColumn(
        "path", F.concat(F.lit("uploads/"), F.col("stored_name")))
