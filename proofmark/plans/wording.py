"""Word lists and message texts of the public data contract.

Everything here is a fixed value: results compare equal only if these match, so they are
kept as plain text in one place.  The messages are Indonesian, as in the contract.
"""

from __future__ import annotations

# Column-name parts that mark personal data and likely targets.
PII_NAME_PARTS = ("email", "phone", "mobile", "address", "ssn", "nik", "passport")
TARGET_NAME_PARTS = ("target", "label", "outcome", "converted", "churn", "revenue")

# Profile warnings.
WARNINGS = {
    "empty": "Dataset tidak memiliki baris.",
    "duplicates": "Ditemukan %d baris duplikat.",
    "missing": "Kolom dengan missing >=20%: ",
    "pii": "Potensi PII: ",
}

# Month names, Indonesian and English.
MONTHS = {
    "januari": 1,
    "january": 1,
    "februari": 2,
    "february": 2,
    "maret": 3,
    "march": 3,
    "april": 4,
    "mei": 5,
    "may": 5,
    "juni": 6,
    "june": 6,
    "juli": 7,
    "july": 7,
    "agustus": 8,
    "august": 8,
    "september": 9,
    "oktober": 10,
    "october": 10,
    "november": 11,
    "desember": 12,
    "december": 12,
}

# Dimension words in questions and the column-name part they stand for.
DIMENSION_WORDS = (
    ("kota", "city"),
    ("city", "city"),
    ("kategori", "category"),
    ("category", "category"),
    ("produk", "product"),
    ("product", "product"),
    ("channel", "channel"),
    ("segmen", "segment"),
    ("segment", "segment"),
    ("campaign", "campaign"),
)

# Metric names to prefer when the question names none.
PREFERRED_METRICS = ("revenue", "sales", "amount", "total", "quantity", "value")

# Question words per intent.  Short English words match whole words only;
# the other stems match at the start of a word ("dibanding" also hits "dibandingkan").
QUALITY_PATTERN = r"\b(missing|kosong|null)"
COMPARISON_PATTERN = r"\b(turun|menurun|decline|dibanding|growth|pertumbuhan)"
TOP_PATTERN = r"\b(top\b|tertinggi|teratas|paling besar|paling tinggi)"
COUNT_PATTERN = r"\b(jumlah baris|berapa baris|count\b|jumlah data)"
MEAN_PATTERN = r"\b(rata|average|mean\b)"
# Column-name parts for the fallback breakdown of a comparison and for dates.
CATEGORY_NAME_PATTERN = "category|kategori"
DATE_NAME_PATTERN = "date|time|timestamp"

# SQL policy.
FORBIDDEN_SQL_WORDS = (
    "insert",
    "update",
    "delete",
    "drop",
    "alter",
    "create",
    "replace",
    "truncate",
    "merge",
    "copy",
    "export",
    "import",
    "attach",
    "detach",
    "install",
    "load",
    "pragma",
    "call",
)
FORBIDDEN_SQL_FUNCTIONS = ("read_csv", "read_parquet", "httpfs", "sqlite_scan", "parquet_scan")
POLICY_REASONS = {
    "empty": "Query kosong.",
    "statements": "Hanya satu statement SQL yang diizinkan.",
    "kind": "Hanya SELECT atau WITH yang diizinkan.",
    "comment": "Komentar SQL tidak diizinkan.",
    "mutation": "Query mengandung operasi mutasi atau akses berbahaya.",
    "external": "Akses file atau network dari query tidak diizinkan.",
}

# Ingest verdicts.
SUPPORTED_EXTENSIONS = ("csv", "parquet")
INGEST_REASONS = {
    "name": "Nama file tidak valid.",
    "format": "Format harus CSV atau Parquet.",
    "empty": "File kosong.",
    "size": "Ukuran file melebihi %d MB.",
}

# Errors of the statistics entry points.
STATISTICS_ERRORS = {
    "columns": "Kolom tidak tersedia: ",
    "two_groups": "compare_groups membutuhkan tepat dua grup.",
    "group_size": "Setiap grup membutuhkan minimal tiga observasi.",
    "pairs": "Correlation membutuhkan minimal empat pasangan observasi.",
    "table": "Chi-square membutuhkan minimal tabel 2x2.",
    "auto": "Auto statistics memerlukan outcome+group atau x+y.",
    "method": "Metode statistik tidak didukung: ",
}
# Errors of the planner.
PLANNING_ERRORS = {
    "blank": "Pertanyaan tidak boleh kosong.",
    "no_metric": "Planner tidak menemukan kolom numerik yang dapat dianalisis.",
}

# The plan texts per evidence key.
PURPOSES = {
    "missing_values": "Mengukur missing value setiap kolom",
    "monthly_comparison": "Membandingkan metrik bulan sebelumnya dan bulan saat ini",
    "segment_contribution": "Mengurutkan kontribusi perubahan berdasarkan %s",
    "top_segments": "Ranking segmen",
    "grouped_aggregate": "Agregasi berdasarkan segmen",
    "aggregate": "Agregasi utama",
}
RISKS = {
    "quality": ["missing value tidak selalu berarti data invalid"],
    "comparison": [
        "perbandingan belum mengontrol seasonality",
        "association bukan causal proof",
    ],
    "top": ["ranking sensitif terhadap definisi metrik dan periode"],
    "grouped": ["agregasi tidak membuktikan hubungan sebab-akibat"],
    "aggregate": ["definisi metrik mengikuti kolom yang tersedia"],
}

# The steps and the chart a plan announces, per kind.
STEPS = {
    "quality": ["periksa missing value", "urutkan kolom bermasalah", "susun batasan kualitas data"],
    "comparison": [
        "filter periode dan segmen",
        "bandingkan dua bulan",
        "urai perubahan per segmen",
        "susun evidence-backed answer",
    ],
    "top": ["agregasikan metrik", "ranking segmen", "ambil top 10", "susun evidence"],
    "grouped": ["filter data", "agregasikan per segmen", "validasi hasil", "susun evidence"],
    "aggregate": [
        "filter data",
        "hitung agregasi",
        "validasi hasil",
        "susun evidence-backed answer",
    ],
}
VISUALIZATIONS = {
    "quality": {"type": "bar", "x": "column", "y": "missing_rate"},
    "comparison": {"type": "bar", "x": "month", "y": "delta"},
    "top": {"type": "bar", "x": "segment", "y": "metric_value"},
    "grouped": {"type": "bar", "x": "segment", "y": "metric_value"},
    "aggregate": {"type": "kpi", "x": None, "y": "metric_value"},
}

# Messages of the critic and limitations of finished tests.
NO_RESULT = "Tidak ada hasil eksekusi."
LIMITATIONS = {
    "compare_groups": "Statistical association is not causal proof.",
    "correlation": "Correlation does not imply causation.",
    "chi_square": "Low expected counts can invalidate chi-square approximation.",
}

# Answer texts.
ANSWER = {
    "title": "## Jawaban",
    "measured": "Untuk pertanyaan **{question}**, hasil terukur adalah **{value}**.",
    "non_null": "Nilai non-null yang dipakai: **{count}**.",
    "evidence": "Evidence: `{id}` [evidence:{key}].",
    "aggregate_limit": "Batasan: hasil mengikuti definisi kolom dan filter yang tersedia pada dataset.",
    "grouped": "Untuk pertanyaan **{question}**, segmen teratas:",
    "bullet": "- `{name}`: **{value}**",
    "segment_total": "Total segmen yang dikembalikan: **{count}**.",
    "grouped_limit": "Batasan: ranking bukan bukti kausal.",
    "comparison": "Untuk pertanyaan **{question}**:",
    "no_months": "Perbandingan bulan tidak menghasilkan baris.",
    "change": "Nilai berubah dari **{previous:g}** menjadi **{current:g}**",
    "rate": " (**{rate:.1%}**)",
    "no_segments": "Kontribusi segmen tidak tersedia.",
    "drop": "Penurunan terbesar pada hasil segmentasi: **{segment}** dengan delta **{delta}**.",
    "comparison_method": "Metode: agregasi read-only per periode dan segmentasi; bukan uji kausal.",
    "comparison_limit": "Batasan: analisis belum mengontrol seasonality, campaign, atau confounder lain.",
    "quality": "Untuk pertanyaan **{question}**, {count} kolom memiliki missing value.",
    "quality_evidence": "Evidence: [evidence:missing_values].",
    "quality_limit": "Batasan: missing tidak otomatis berarti data invalid.",
    "alt_text": "Bar chart {y} berdasarkan {x}; sumber {key}.",
}
