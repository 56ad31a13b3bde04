"""The static source catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.session import inline_table

# Key, name, type, start address, language, strategy, requests per minute, pages per run.
SEEDS = [
    ("byu_speeches_es", "BYU Speeches Espanol", "byu_speeches_es", "https://speeches.byu.edu/spa/talks/", "es",
     "listing_and_talk_pages", 30, 12),
    ("byu_speeches", "BYU Speeches English", "byu_speeches_en", "https://speeches.byu.edu/talks/", "en",
     "listing_and_talk_pages", 30, 12),
    ("discursos_sud", "Discursos SUD", "discursos_sud", "https://discursosud.com/", "es", "wordpress_posts", 20, 10),
    ("general_conference", "Conferencia General", "general_conference",
     "https://www.churchofjesuschrist.org/study/general-conference", "es", "official_library_pages", 20, 10),
    ("church_manuals", "Manuales de la Iglesia", "church_manuals",
     "https://www.churchofjesuschrist.org/study/manual", "es", "official_library_pages", 20, 10),
    ("joseph_smith_papers", "Joseph Smith Papers", "joseph_smith_papers", "https://www.josephsmithpapers.org/", "en",
     "historical_documents", 20, 8),
    ("byu_rsc", "BYU Religious Studies Center", "byu_rsc", "https://rsc.byu.edu/", "en", "book_article_pages", 20, 8),
    ("come_follow_me", "Come, Follow Me", "church_manuals",
     "https://www.churchofjesuschrist.org/study/manual/come-follow-me", "es", "official_library_pages", 20, 8),
    ("teachings_presidents", "Teachings of Presidents of the Church", "church_manuals",
     "https://www.churchofjesuschrist.org/study/manual/teachings-presidents", "en", "official_library_pages", 20, 8),
    ("scriptures", "Escrituras", "scriptures", "https://www.churchofjesuschrist.org/study/scriptures", "es",
     "official_scripture_pages", 20, 8),
]
COLUMNS = ["source_key", "source_name", "source_type", "base_url", "language", "crawl_strategy", "rate_limit", "max_pages"]


def seed_sources(spark: SparkSession) -> DataFrame:
    return inline_table(spark, COLUMNS, SEEDS)
