"""Schemas of the data model (Spark DDL)."""

from __future__ import annotations

AUTHOR = "STRUCT<name: STRING, affiliation: STRING, orcid: STRING>"
SCHEMAS = {
    "issues": "id STRING, title STRING, series STRING, descriptionHtml STRING, cover STRING, ojsUrl STRING, datePublished STRING, sections ARRAY<STRUCT<title: STRING, articles: ARRAY<STRING>>>",
    "articles": f"urlPath STRING, submissionId STRING, title STRING, subtitle STRING, authors ARRAY<{AUTHOR}>, doi STRING, doiUrl STRING, keywords ARRAY<STRING>, abstractHtml STRING, referencesHtml STRING, galleys ARRAY<STRUCT<label: STRING, isPdf: BOOLEAN, viewUrl: STRING, downloadUrl: STRING, localPdf: STRING>>, datePublished STRING, citation STRING, bibtexUrl STRING, bibtexText STRING, risUrl STRING, risText STRING, issueId STRING, issueTitle STRING, section STRING, categories ARRAY<STRING>, licenseHtml STRING, ojsUrl STRING",
    "pages": "slug STRING, title STRING, html STRING, sourceUrl STRING",
    "announcements": "id STRING, title STRING, date STRING, html STRING, ojsUrl STRING",
    "journal": "name STRING, description STRING, keywords STRING, issn STRING, ojsUrl STRING, submitUrl STRING, submissionsInfoUrl STRING, logo STRING, favicon STRING, homepageHtml STRING, sidebarBlocks ARRAY<STRUCT<id: STRING, title: STRING, titleHidden: BOOLEAN, html: STRING>>, footerHtml STRING, nav ARRAY<STRUCT<label: STRING, path: STRING>>",
    "stats_entry": "ojsViews BIGINT, monthlyOjsViews MAP<STRING, BIGINT>, pdfDownloads BIGINT, monthlyDownloads MAP<STRING, BIGINT>, asOf STRING, mirrorViews BIGINT, monthlyMirrorViews MAP<STRING, BIGINT>",
    "submissions_raw": "id INT, dateSubmitted STRING, status INT",
    "submissions": "monthly MAP<STRING, BIGINT>, statusCounts STRUCT<published: BIGINT, underReview: BIGINT, declined: BIGINT>, total BIGINT",
    "under_review": f"id STRING, title STRING, authors ARRAY<{AUTHOR}>, preprintUrl STRING, prereviewUrl STRING, pubpeerUrl STRING, abstractHtml STRING, laySummary STRING, status STRING, handlingEditor STRING, submissionDate STRING",
    "extras_entry": "peerReviewUrl STRING, reproCertUrl STRING, dataUrl STRING, materialsUrl STRING, laySummary STRING",
    "team": "sections ARRAY<STRUCT<title: STRING, hasPhotos: BOOLEAN, noteHtml: STRING, members: ARRAY<STRUCT<name: STRING, affiliation: STRING, roles: STRING, slug: STRING>>>>",
    "spans": "doc STRING, page INT, page_w DOUBLE, page_h DOUBLE, block INT, block_type INT, line INT, span INT, text STRING, size DOUBLE, flags INT, font STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE",
}
