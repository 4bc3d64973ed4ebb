"""Texts and formats that the results must reproduce exactly."""

NOT_AVAILABLE = "N/A"
NO_SQL = "-- SQL code not available --"
FENCE = "```"

# Node styles of the lineage graph and their priority; the highest wins.
STYLE_PRIORITY = {"db": 1, "source": 2, "box": 3}
FK_LABEL = "FK"

# Line formats of the lineage graph.
GRAPH_HEADER = "graph TD;"
NODE_FORMATS = {"box": '    %s["%s"]', "db": '    %s[("%s")]', "source": '    %s(("%s"))'}
LABELLED_EDGE_FORMAT = '    %s -- "%s" --> %s'
PLAIN_EDGE_FORMAT = "    %s --> %s"

# Lineage document.
LINEAGE_TITLE = "# 🌐 Global Data Lineage"
NO_LINEAGE = ["graph TD;", "  A[No lineage data found]"]

# Entity relationship diagram.
ERD_HEADER = "erDiagram"
ERD_FORMAT = '    "%s" ||--o{ "%s" : "%s to %s"'
NO_FKS = "No foreign key relationships found to generate a diagram."

# Catalog document of a database.
CATALOG_TITLE = "# 📁 Data Catalog for %s"
ERD_HEADING = "## 🚀 Entity Relationship Diagram (ERD)"
VIEWS_HEADING = "## 🔎 Views"
TABLES_HEADING = "## 🗂️ Tables"
VIEW_HEADING = "### 📄 View: `%s`"
TABLE_HEADING = "### 📄 Table: `%s`"
SUMMARY_HEADING = "**AI-Generated Summary:**"
SQL_HEADING = "**SQL Definition:**"
QUOTE_FORMAT = "> %s"
NO_VIEWS = "No views found in this database."
NO_TABLES = "No tables found in this database."
NO_SUMMARY = "(No summary available)"
COLUMN_TABLE_HEADER = "| Column Name | Data Type | AI-Generated Description |"
COLUMN_TABLE_RULE = "| :--- | :--- | :--- |"
COLUMN_ROW_FORMAT = "| `%s` | `%s` | %s |"

# Catalog document of a model project.
MODELS_TITLE = "# 🧬 Data Catalog for %s (dbt)"
MODEL_HEADING = "## 🚀 Model: `%s`"
MODEL_SUMMARY_HEADING = "### AI-Generated Model Summary"
MODEL_LINEAGE_HEADING = "### AI-Generated Lineage (Mermaid)"
NO_CHART = "*(Lineage chart generation failed)*"
COLUMN_DETAILS_HEADING = "### Column Details"
NO_COLUMNS_ROW = "| (No columns found) | | |"
NO_DESCRIPTION = "(AI description failed)"

# Database comments.
COMMENT_VIEW_FORMAT = 'COMMENT ON VIEW "%s"."%s" IS \'%s\';'
COMMENT_TABLE_FORMAT = 'COMMENT ON TABLE "%s"."%s" IS \'%s\';'
COMMENT_COLUMN_FORMAT = 'COMMENT ON COLUMN "%s"."%s"."%s" IS \'%s\';'

# Generation budgets in tokens, by kind of prompt.
MAX_TOKENS = {
    "table": 200,
    "view": 200,
    "model": 200,
    "column": 50,
    "column_metadata": 250,
    "lineage": 1000,
    "drift": 10,
}
