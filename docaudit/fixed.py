"""Word lists, patterns, limits and message texts.

They decide results, so they are written out plainly in one place. Patterns keep
the JavaScript notation; ``functions.text.spark_regex`` and
``functions.text.duck_regex`` adapt ``\\s``, ``\\b`` and ``$`` to each engine.
"""

# JavaScript white space and line ends (what ``\s`` matches and ``trim`` removes).
WS_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)

# ---- fixed values: tokeniser ------------------------------------------------
TOKEN_CLASS = "[a-z0-9\u3040-\u30ff\u3400-\u9faf]"
MIN_TOKEN_CHARS = 2
EVIDENCE_STOP_WORDS = [
    "the", "and", "for", "that", "with", "this", "from", "into", "using", "used", "our", "are",
    "was", "were", "than", "have", "has", "had", "also", "then", "their", "there", "about",
    "ため", "こと", "これ", "それ", "および", "また", "する", "した", "して", "ある", "ない",
]
KEYWORD_STOP_WORDS = [
    "the", "and", "for", "with", "that", "this", "from", "using", "into", "our", "are", "was",
    "were", "than", "have", "has", "also", "する", "した", "して", "こと", "これ", "それ", "ある", "ない",
]
DEFAULT_KEYWORDS = ["研究", "手法"]
KEYWORD_LIMIT = 8

# ---- fixed values: claim patterns and limits ---------------------------------
CLAIM_PATTERNS = [
    r"\b(we show|we demonstrate|we propose|our method|results indicate|outperform|improve)\b",
    r"\b(fix|prevent|mitigate|refactor|stabilize|rollback|retry|coverage|latency|regression)\b",
    r"(本研究|提案|示す|改善|有効|性能|結果|達成|修正|防止|安定化|対応|再発防止|テスト追加)",
]
CANDIDATE_CUE = r"(because|therefore|thus|条件|比較|従来|有効|改善)"
CONDITION_CUE = r"(because|therefore|thus|if|when|compared|baseline|条件|比較|従来|場合|有効|改善)"
CLAIM_MIN_CHARS = 12
CLAIM_MAX_CHARS = 280
MAX_CLAIMS = 36
FALLBACK_MIN_CLAIMS = 12
HEADLINE_CHARS = 64
SEGMENT_SIZE = 120
SEGMENT_OVERLAP = 24
MAX_SEGMENTS = 6
PROMPT_PARAGRAPH_CHARS = 1200
REFINER_ROUNDS = 2
WEAK_QUALITY = 2.2
WEAK_ISSUES = 2
TOP_RISKS = 50

# ---- fixed values: evidence audit --------------------------------------------
QUANTITATIVE = (
    r"(?:\d+(\.\d+)?%?|\b[0-9]+\b|倍|秒|ms|fps|精度|accuracy|auc|f1|bleu|p値|有意|比較)"
)
# The same predicate without a regex: a digit, or one of these.
QUANTITATIVE_WORDS = [
    "倍", "秒", "ms", "fps", "精度", "accuracy", "auc", "f1", "bleu", "p値", "有意", "比較",
]
SUPPORT_SCORE = 0.18
STRONG_SCORE = 0.35
HIGH_BELOW = 0.22
COVERAGE_BELOW = 0.3
LOW_BELOW = 0.58
SUPPORT_LIMIT = 3

# ---- fixed values: logic rules -----------------------------------------------
NUMBER = r"(?:\d+(\.\d+)?%?|\b[0-9]+\b)"
VAGUE = [
    r"\b(significant|substantial|dramatic|remarkable|effective|efficient)\b",
    r"(大幅|十分|顕著|有効|効果的|高速化|改善した|優れている|高い性能)",
]
ABSOLUTE = [
    r"\b(always|never|all|every|entirely|completely)\b",
    r"(すべて|常に|完全に|必ず|全て|どの環境でも)",
]
COMPARATIVE = [
    r"\b(better|faster|stronger|improved|outperform|superior)\b",
    r"(優れる|改善|高速|高精度|高性能|上回る)",
]
COMPARATOR = [
    r"\b(than|versus|vs\.?|compared to|baseline|prior)\b",
    r"(従来|既存|比較|ベースライン|対して)",
]
CONDITION = [
    r"\b(when|if|under|for|in case)\b",
    r"(条件|場合|とき|下で|環境)",
]
LOGIC_SHORT_CHARS = 45
SEVERITIES = ["LOW", "MEDIUM", "HIGH"]

# ---- fixed values: quality gate (paragraphs, total characters) ----------------
QUALITY_GATE = {
    "PAPER": (8, 2500),
    "PR": (6, 900),
    "DOC": (6, 1200),
    "SHEET": (6, 700),
}

# ---- fixed values: headings ----------------------------------------------------
PR_DEFAULT_TITLE = "PR Overview"
PR_DIFF_TITLE = "Diff Changes"
PR_SIGNALS_TITLE = "PR Review Signals"
ARTIFACT_SIGNALS_TITLE = "Artifact Signals"
SHEET_ROWS_TITLE = "Sheet Rows"
SHEET_JSON_TITLE = "Sheet JSON"
SHEET_MAX_ROWS = 500
SHEET_NUMERIC_ROW = r"(?:^|,|\s)\d+(?:\.\d+)?(?:,|\s|$)"
SHEET_FORMULA_ROW = r"(?:^|\W)=\s*[A-Z]"
SHEET_SOURCE_WORD = r"\b(source|origin|reference|根拠|出典)\b"
DOC_EVIDENCE_WORD = r"\b(evidence|data|result|metric|根拠|データ|結果|実験)\b"
DOC_DECISION_WORD = r"\b(decision|trade[- ]?off|理由|判断|選定)\b"
DOC_RISK_WORD = r"\b(risk|constraint|limitation|課題|制約|リスク)\b"
DOC_ASSUMPTION_WORD = r"\b(assumption|premise|前提|想定)\b"

# ---- fixed values: diff rules ---------------------------------------------------
CODE_FILE = r"\.(?:ts|tsx|js|jsx|mjs|cjs|py|go|java|kt|rb|php|rs|swift|c|cc|cpp|h|hpp|cs)$"
TEST_FILE = r"(?:^|\/)(?:test|tests|__tests__|spec|specs)(?:\/|$)|\.(?:test|spec)\.[jt]sx?$"
MIGRATION_FILE = r"(?:migration|migrations|schema|ddl|sql|prisma)"
SECURITY_FILE = r"(?:auth|permission|policy|acl|oauth|token|secret|credential|key|iam|security)"
# id, message, pattern, ignore case
DIFF_RISK_RULES = [
    ("todo", "TODO/FIXME/HACKが追加されています", r"\b(?:TODO|FIXME|HACK)\b", True),
    (
        "debug",
        "デバッグ出力と思われる行が追加されています",
        r"\b(?:console\.log|print\(|fmt\.Print|logger\.debug|System\.out\.println)\b",
        False,
    ),
    (
        "suppress",
        "型/静的解析の抑制が追加されています",
        r"\b(?:@ts-ignore|eslint-disable|any\b|type:\s*ignore|noinspection)\b",
        True,
    ),
    (
        "skip_test",
        "テストスキップ記法が追加されています",
        r"\b(?:it|test|describe)\.skip\b|\bskip\(",
        True,
    ),
    (
        "secret",
        "シークレットのハードコード疑いがある文字列があります",
        r"\b(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z-_]{20,}|xox[baprs]-[0-9A-Za-z-]{10,}"
        r"|-----BEGIN (?:RSA|EC|OPENSSH) PRIVATE KEY-----)\b",
        False,
    ),
]
REMOVED_ASSERTION = r"\b(?:expect\(|assert\(|toEqual\(|toBe\(|pytest\.raises|should\b)\b"
MIGRATION_WORD = r"\b(?:migration|migrate|schema|ddl|roll ?back|ロールバック|移行)\b"
CHANGED_NAME_PATTERNS = [
    r"\bfunction\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"\b(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\([^)]*\)\s*=>",
    r"\b([A-Za-z_][A-Za-z0-9_]*)\s*:\s*function\s*\(",
    r"\bclass\s+([A-Za-z_][A-Za-z0-9_]*)\b",
]
LARGE_DIFF_LINES = 1200
PREVIEW_LINES = 3
PREVIEW_CHARS = 260
LISTED_PATHS = 5
LISTED_NAMES = 8

# ---- fixed values: messages that become paragraphs, warnings and reasons ---------
MSG = {
    "sheet_no_formula": "信号: 数式/計算ロジックの明示が少ないため、算出根拠の追跡が難しい可能性があります。",
    "sheet_no_numbers": "信号: 数値データが少ないため、意思決定根拠の定量性が不足している可能性があります。",
    "sheet_no_source": "信号: 出典（source/reference）の明示が不足しています。",
    "sheet_no_numbers_warning": "数値セルらしき行が検出できません。集計結果の妥当性を評価しにくい状態です。",
    "doc_no_evidence": "信号: 根拠（Evidence/Data）を示す記述が少ない可能性があります。",
    "doc_no_decision": "信号: 意思決定理由（Decision/Trade-off）の記述が不足しています。",
    "doc_no_risk": "信号: リスク/制約（Risk/Constraint）の記述が不足しています。",
    "doc_no_assumption": "信号: 前提条件（Assumption/Premise）の明示が不足しています。",
    "doc_no_evidence_warning": "根拠を示す語が少ないため、主張と根拠の対応が弱くなる可能性があります。",
    "fallback_split": "no structured paragraph blocks found; fallback paragraph split applied",
    "no_headings": "no section headings detected",
    "pr_no_diff": "unified diffが見つからないため、コード変更の根拠検査は限定されます",
    "pr_no_tests": "コード変更がある一方でテスト変更が見つかりません。回帰検証の根拠が不足する可能性があります。",
    "pr_security": "認証/権限/秘密情報に関わる変更です。境界条件と権限モデルの説明が必要です。",
    "pr_migration": "スキーマ変更の説明が見当たりません。移行手順とロールバック条件を追記してください。",
    "pr_large": "差分が大きいため、段階的リリース計画・監視項目・失敗時対応の明記を推奨します。",
    "pr_risk_suffix": "。意図と安全策を本文に明示してください。",
    "pr_assertions": "検証ロジックの削除が含まれます。削除理由と代替検証の説明が必要です。",
    "no_evidence": (
        "主張を直接裏づける本文段落が見つかりません（一致度最大 {best}）。"
        "対応する実験結果・比較結果・引用を明示してください。"
    ),
    "narrow_evidence": (
        "対応段落はありますが、主張に対する根拠の対応範囲が狭いです（一致度平均 {avg} / カバー率 {coverage}）。"
        "主張内の条件・結果に対応する記述を追加してください。"
    ),
    "numbers_unsupported": (
        "主張は数値・比較を含みますが、根拠段落に定量情報が不足しています。"
        "比較対象・評価条件・数値結果を追記してください。"
    ),
    "thin_evidence": (
        "根拠は存在しますが、裏づけ密度が十分ではありません（一致度最大 {best}）。"
        "主張に対する直接根拠をもう1段落以上追加すると安全です。"
    ),
    "no_evidence_risk": "この主張に対する重大な根拠リスクは検出されませんでした。",
    "absolute_without_condition": "断定表現がある一方で、成立条件が明示されていません",
    "vague_without_number": "定量根拠がないまま抽象語で効果を述べています",
    "comparison_without_baseline": "比較を示唆していますが、比較対象（ベースライン）が不明です",
    "no_number_condition_comparator": "数値・条件・比較対象の3要素が不足しています",
    "short_without_number": "主張文が短く、再現可能性を担保する具体性が不足しています",
    "prior_art": "主張の技術コア語を優先した検索式です。先行技術調査の初期クエリとして利用できます。",
    "evidence_title": "根拠不足: ",
    "logic_title": "論理の曖昧さ: ",
    "todo_risk_default": "該当主張の根拠を補強してください",
    "vague_suggestion": "数値・条件・比較対象を追記して主張を具体化してください",
    "risk_vague_suggestion": "根拠となる条件・数値・比較対象を明示してください",
    "vague_default": "具体化の余地があります",
    "oral_pass": "主張の骨子は明確です。次は根拠の定量性を補強しましょう。",
    "oral_revise": "回答が短く根拠が不足しています。比較条件・数値・根拠段落を追加してください。",
    "oral_draft_pass": "本研究の新規性は、従来法と比較して有効性を定量評価した点にあります。",
    "oral_draft_revise": "提案手法は既存手法と比較して、特定条件下で性能向上を示します。",
    "oral_todo": "回答文に比較条件と定量根拠を追加",
    "oral_fallback": "この研究の新規性を、比較対象を含めて1文で説明してください。",
    "oral_focus_fallback": "Claim {claim} を支える実験条件と比較対象を、1文で具体化してください。",
    "archive_no_tex": "No .tex file found in archive.",
    "no_claims": "claim extraction via llm failed: llm produced empty claim list",
    "refiner_empty": "claim refiner iteration {n}: no replacement candidates available",
}
PREFLIGHT_KINDS = {
    "MISSING_FIGURE_REFERENCE": ("error", "図 {x} が本文中で一度も参照されていません。", "図参照の欠落"),
    "UNKNOWN_FIGURE_REFERENCE": ("error", "本文で参照されている図ラベル {x} が定義されていません。", "未定義の図参照"),
    "UNKNOWN_FIGURE_NUMBER": ("warning", "本文で参照されている図番号 {x} が存在しません。", "未定義の図参照"),
    "MISSING_BIB_ENTRY": ("error", "本文で使用している引用キー {x} が参考文献一覧にありません。", "参考文献エントリ欠落"),
    "UNCITED_BIB_ENTRY": ("warning", "参考文献キー {x} が本文中で一度も引用されていません。", "未引用の参考文献"),
}
PROGRESS_BY_STATUS = {
    "READY": "AIオーケストレーション完了",
    "FAILED": "AIオーケストレーション失敗",
}
PROGRESS_BY_STEP = {
    "extract": "Extractorが成果物を構造化しています",
    "evidence": "Evidence Auditorが主張と根拠を照合しています",
    "logic": "Claim Miner / Logic Sentinelが論点を解析しています",
    "prior_art": "Prior-Art Coachが比較観点を生成しています",
    "finalize": "Synthesizerが最終レポートを統合しています",
}
PROGRESS_QUEUED = "Plannerが解析計画を準備しています"

# ---- fixed values: enums, archive and request limits -------------------------------
ARTIFACT_TYPES = ["PAPER", "PR", "DOC", "SHEET"]
ARTIFACT_FORMATS = ["plain", "markdown", "diff", "json"]
FORMATS_BY_TYPE = {
    "PR": ["plain", "markdown", "diff"],
    "DOC": ["plain", "markdown"],
    "SHEET": ["plain", "json"],
    "PAPER": ["plain"],
}
RETENTION_MODES = ["NO_SAVE", "SAVE"]
AGENT_ROLES = [
    "PLANNER", "EXTRACTOR", "CLAIM_MINER", "PREFLIGHT_GUARDIAN",
    "EVIDENCE_AUDITOR", "LOGIC_SENTINEL", "PRIOR_ART_COACH", "SYNTHESIZER",
]
ARTIFACT_MIN_CHARS = 40
ARTIFACT_MAX_CHARS = 200_000
ARTIFACT_MAX_TITLE = 120
ARTIFACT_MAX_SOURCE_REF = 240
ARCHIVE_EXTENSIONS = [
    ".tex", ".bib", ".bst", ".cls", ".sty", ".txt", ".png", ".jpg", ".jpeg", ".pdf", ".eps", ".csv",
]
ARCHIVE_MAX_FILES = 2000
ARCHIVE_MAX_FILE_BYTES = 20 * 1024 * 1024
ARCHIVE_MAX_TOTAL_BYTES = 200 * 1024 * 1024
SYMLINK_MODE = 0o120000
MODE_MASK = 0o170000
RATE_LIMITS = {"upload": (20, 60_000), "artifact": (20, 60_000), "analyze": (60, 60_000)}
PDF_MAGIC = "%PDF-"
SPARSE_MIN_PARAGRAPHS = 4
SPARSE_MIN_TEXT_ITEMS = 40
LINE_MERGE_TOLERANCE = 2.5
ANSWER_PASS_CHARS = 80
COMMON_PROMPT_RULES = [
    "出力はJSONのみ。Markdownは出力しない。",
    "IDは入力に存在するものだけを使う。新規IDを作らない。",
    "不確実な場合でも推測を作らず、根拠不足として扱う。",
    "説明文は日本語で簡潔に記述する。",
]

# ---- fixed values: prompts ------------------------------------------------------------
CLAIM_PROMPT = {
    "task": "タスク: 文書から主要な主張(claim)を抽出する。",
    "schema": [
        "出力スキーマ:",
        '{ "claims": [{ "claimId": "...", "text": "...", "paragraphIds": ["..."], "confidence": "low|medium|high" }] }',
    ],
    "count": "最大件数: ",
    "input": ["注意: claim.text は元文の意味を維持し、冗長にしない。", "入力文書:"],
}
EVIDENCE_PROMPT = {
    "task": "タスク: 各claimに対応する根拠段落・図・引用を対応づける。",
    "schema": [
        "出力スキーマ:",
        '{ "evidence": [{ "claimId": "...", "paragraphIds": ["..."], "figureIds": ["..."], "citationKeys": ["..."], "reason": "..." }] }',
    ],
    "claims": "Claims:",
    "none": "- (no claims)",
    "input": ["入力文書:"],
}
ORAL_PROMPT = {
    "task": "タスク: 口頭試問で使う質問を1つ生成し、期待回答の要点を作る。",
    "schema": [
        "出力スキーマ:",
        '{ "question": "...", "expectedAnswer": "...", "claimId": "...", "paragraphIds": ["..."] }',
        "question と expectedAnswer は日本語で書く。",
    ],
    "id": "対象claim ID: ",
    "claim": "対象claim: ",
    "input": ["入力文書:"],
}

# ---- fixed values: LaTeX commands and citation marks --------------------------------------
LATEX_SECTION = r"\\(subsubsection|subsection|section)\{([^}]*)\}"
LATEX_FIGURE = r"(?s)\\begin\{figure\}.*?\\end\{figure\}"
LATEX_INCLUDE = r"\\(?:input|include)\{([^}]+)\}"
LATEX_CITE = r"\\cite[a-zA-Z*]*\{([^}]*)\}"
LATEX_REF = r"\\(?:ref|autoref|eqref)\{([^}]*)\}"
FIGURE_NUMBER = r"\b(?:Fig\.?|Figure)\s*(\d+)\b"
NUMERIC_CITE = r"\[\d+(?:\s*,\s*\d+)*\]"
NUMERIC_CITE_KEYS = r"\[(\d+(?:\s*,\s*\d+)*)\]"
AUTHOR_YEAR = r"\([A-Z][A-Za-z-]+(?: et al\.)?,\s*\d{4}[a-z]?\)"
AUTHOR_YEAR_KEY = r"\(([A-Z][A-Za-z-]+(?: et al\.)?,\s*\d{4}[a-z]?)\)"

# ---- fixed values: score of an extraction source (cap, points per unit) -------------------
SOURCE_SCORE = {
    "paragraphs": (60, 1.6),
    "chars_divided_by": (45, 240),
    "sections": (18, 3.0),
    "bib": (14, 0.8),
    "cited_share": (16, 32),
    "warning": 1.2,
}
# points for a mean paragraph length in the first range, from the second bound on, else
SOURCE_MEAN_CHARS = ((60, 1000, 12.0), (30, 5.0), -8.0)
