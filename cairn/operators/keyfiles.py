"""Key files of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.text import directories

#: Fixed values.
KEY_FILES = [
    "package.json", "README.md", "readme.md", "src", "frontend", "backend", "packages", "docker-compose.yml", "docker-compose.yaml",
    "compose.yml", "compose.yaml", "Dockerfile", ".github/workflows", "prisma/schema.prisma", "vite.config.ts", "vite.config.js", "tsconfig.json",
]


def key_files(files: DataFrame) -> DataFrame:
    """(path) of the key files and folders that are there."""
    there = files.select("path").unionByName(directories(files.select("path")))
    return there.filter(F.col("path").isin(KEY_FILES)).distinct().orderBy("path")
