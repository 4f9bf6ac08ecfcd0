"""Fixed values of the compatible behaviour.

Everything in this module is data: word lists, patterns, templates and default
parameters that have to equal the values users of the original system rely on.
"""

# --- fixed values: sentence-aware chunking -------------------------------------------------
SENTENCE_SEPARATORS = ["。", "！", "？", "\n", ".", "!", "?"]
SENTENCE_ENDINGS = ["。", "！", "？", ".", "!", "?"]
CHUNK_PREFIX = "[{source} 第{page}页] "
CHUNK_SIZE = 512
CHUNK_OVERLAP = 100
CHUNK_MIN = 100

# --- fixed values: title patterns (chunker, layout analyser, page parser) ------------------
TITLE_PATTERNS_CHUNKER = [
    r"^第[一二三四五六七八九十]+章",
    r"^第[一二三四五六七八九十]+节",
    r"^第\d+章",
    r"^第\d+节",
    r"^\d+[、.．]\s*",
    r"^[一二三四五六七八九十]+[、]",
    r"^[\(（]\d+[）\)]",
    r"^[1-9]\d*\.\d+",
    r"^[1-9]\d*\.\d+\.\d+",
]
TITLE_PATTERNS_LAYOUT = [
    r"^第[一二三四五六七八九十]+[章节]",
    r"^第\d+[章节]",
    r"^\d+[、.．]\s*\S+",
    r"^[一二三四五六七八九十]+[、]\s*\S+",
    r"^[\(（]\d+[）\)]\s*\S+",
    r"^[1-9]\d*\.\d+\s+\S+",
]
TITLE_PATTERNS_PAGE = [
    r"^第[一二三四五六七八九十]+章",
    r"^第\d+章",
    r"^\d+[、.]\s*",
    r"^[一二三四五六七八九十]+[、]",
    r"^[\(（]\d+[）\)]",
]
TITLE_MAX_CHARS = 100

# --- fixed values: page geometry -----------------------------------------------------------
HEADER_SHARE = 0.15
FOOTER_SHARE = 0.1

# --- fixed values: lexical index -----------------------------------------------------------
FINANCE_TERMS = [
    "摊余成本法", "公允价值", "净资产收益率", "市盈率", "市净率",
    "资产负债表", "利润表", "现金流量表", "所有者权益", "营业收入",
    "净利润", "毛利率", "净利率", "ROE", "ROA", "EBITDA",
    "同比增长", "环比增长", "复合增长率", "年化收益率",
    "股票", "债券", "基金", "期货", "期权", "ETF",
    "多头", "空头", "做多", "做空", "对冲", "套利",
    "归属于上市公司股东的净利润", "归属于母公司所有者的净利润",
    "加权平均净资产收益率", "基本每股收益", "每股收益",
    "研发投入", "研发费用", "总资产", "资产负债率",
]
STOPWORDS = [
    "的", "是", "在", "了", "和", "与", "或", "等", "及",
    "这", "那", "有", "为", "以", "于", "上", "下", "中",
    "第", "页", "年", "月", "日", "元", "万元", "亿元",
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "shall",
    "can", "need", "dare", "ought", "used", "to", "of", "in",
    "for", "on", "with", "at", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below",
]
SEGMENT_WINDOW = 4
BM25_K1 = 1.5
BM25_B = 0.75

# --- fixed values: retrieval ---------------------------------------------------------------
RRF_K = 60
RRF_K_EVAL = 40
CHAIN_TOP_K = 20
CHAIN_RERANK_TOP_K = 5
IVF_NPROBE = 10

# --- fixed values: synonyms (ordered; query rewriting and recall recovery) -----------------
REWRITE_SYNONYMS = {
    "装机量": ["装车量", "装机容量", "装机规模"],
    "营收": ["营业收入", "收入", "销售额"],
    "净利润": ["净利", "盈利", "利润"],
    "归母净利": ["净利润", "归母净利润", "归属母公司股东的净利润"],
    "毛利率": ["毛利", "毛利润率", "盈利水平"],
    "ROE": ["净资产收益率", "股东权益回报率"],
}
RECOVERY_SYNONYMS = {
    "装机量": ["装车量", "装机容量", "装机规模"],
    "营收": ["营业收入", "收入", "销售额"],
    "净利润": ["净利", "盈利", "利润"],
    "毛利率": ["毛利", "毛利润率"],
    "ROE": ["净资产收益率", "股东权益回报率"],
    "研发投入": ["研发费用", "研发支出", "R&D投入"],
    "市值": ["市场价值", "总市值"],
    "增长率": ["同比增速", "增长速度", "增幅"],
}

# --- fixed values: question patterns -------------------------------------------------------
COMPANY_BEFORE_INDICATOR = r"[一-鿿]{2,10}(?=的[营净毛利总研资每资加资])"
COMPANY_AFTER_LOCATION = r"在[^，]+中，([一-鿿]{2,10})的"
FILE_SUFFIX = r"在\w+_\w+_([^第]+?第)"
LOCATION_PREFIX = r"^在.+?第\d+页中，"
UNIT_SUFFIX = r"（单位：.+?）"
QUESTION_TEMPLATE = "在{doc}第{page}页中，{company}的{indicator}是多少？"
QUESTION_TEMPLATE_UNIT = "在{doc}第{page}页中，{company}的{indicator}是多少？（单位：{unit}）"
COMPARISON_TEMPLATE = "{first}和{second}的{indicator}对比如何？"

# --- fixed values: answers -----------------------------------------------------------------
REFUSAL_PHRASES = [
    "根据现有研报信息无法回答",
    "提供的文档中未包含",
    "上下文中没有相关信息",
    "无法从提供的资料中找到",
]
REFUSAL_ANSWER = "根据现有研报信息无法回答该问题。提供的文档中未包含与问题相关的信息。"
QA_PROMPT = """你是一个专业的金融分析助手。请根据以下上下文信息回答用户的问题。

上下文信息：
{context}

问题：{question}

回答要求：
1. 只基于提供的上下文信息回答，不要编造信息
2. 如果上下文信息不足以回答问题，请回答"根据现有研报信息无法回答该问题"
3. 回答中标注引用来源，格式为 [Source X]，其中X是上下文中提供的来源编号
4. 如果涉及数据，请明确指出数据来源的页码

回答：
"""
CONTEXT_ENTRY = "[Source {rank}] (来源: {source}, 第 {page} 页)\n{text}"
MOCK_ANSWER = (
    "[模拟回复] 我理解您的问题是: {head}...\n\n"
    "由于未配置有效的 LLM 后端，这是模拟回复。请配置 API 密钥以启用真实回复。"
)
GENERATION_ERROR = "抱歉，生成回复时出现错误: {error}"
NUMBER_IN_ANSWER = r"[\d,]+\.?\d*%?"
DATE_IN_ANSWER = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}/\d{1,2}/\d{1,2}"
CITATION_MARKS = ["[Source", "根据文档"]
UNVERIFIED_NUMBER_WEIGHT = 0.3
UNVERIFIED_DATE_WEIGHT = 0.2
NO_CITATION_WEIGHT = 0.3
NO_CITATION_MIN_CHARS = 100
HALLUCINATION_LIMIT = 0.5
HALLUCINATION_WARNING = "\n\n[警告] 此回答可能包含未验证的信息，请核实后使用。"
VERIFY_TRUSTED = "回答可信"
VERIFY_NO_CITATION = "回答缺少引用来源"
VERIFY_HALLUCINATION = "检测到可能的幻觉"
IRRELEVANT_SCORE = 0.3
LATENCY_LIMIT_MS = 3000.0
CACHE_ENTRIES = 1000
BADCASE_TYPES = ["empty_recall", "irrelevant_answer", "hallucination", "high_latency"]
PREVIEW_CHARS = 200

# --- fixed values: indicator mining --------------------------------------------------------
# first match per pattern; the indicator decides the unit
INDICATOR_PATTERNS = [
    (r"(?:2025年|报告期内|本期|公司)[^。]{0,30}?营业收入[：\s]*?([\d,]+(?:\.\d+)?)\s*亿元", "营业收入"),
    (r"营业总收入[：\s]*?([\d,]+(?:\.\d+)?)\s*亿元", "营业收入"),
    (r"实现营业收入[：\s]*?([\d,]+(?:\.\d+)?)\s*亿元", "营业收入"),
    (r"营业收入[：\s]*?([\d,]+(?:\.\d+)?)\s*亿元", "营业收入"),
    (r"营业收入合计[=为：]{1,2}\s*([\d,]+(?:\.\d+)?)\s*亿", "营业收入"),
    (r"(?:2025年|报告期内|本期|公司)[^。]{0,30}?归属于上市公司股东的净利润[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "净利润"),
    (r"(?:2025年|报告期内|本期|公司)[^。]{0,30}?净利润[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "净利润"),
    (r"实现归属于上市公司股东的净利润[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "净利润"),
    (r"归属于上市公司股东的净利润[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "净利润"),
    (r"归母净利润[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "净利润"),
    (r"加权平均净资产收益率[：\s]*?([\d,]+(?:\.\d+)?)%", "净资产收益率"),
    (r"加权平均净资产收益率[：\s]*?([\d,]+(?:\.\d+)?)", "净资产收益率"),
    (r"(?:基本每股收益|每股收益)[：\s]*?([\d,]+(?:\.\d+)?)\s*元", "每股收益"),
    (r"毛利率[：\s]*?([\d,]+(?:\.\d+)?)%", "毛利率"),
    (r"总资产[：\s]*?([\d,]+(?:\.\d+)?)\s*亿元", "总资产"),
    (r"资产总额[：\s]*?([\d,]+(?:\.\d+)?)\s*亿元", "总资产"),
    (r"研发投入[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "研发投入"),
    (r"研发费用[：\s]*?([\d,]+(?:\.\d+)?)\s*亿", "研发投入"),
    (r"资产负债率[：\s]*?([\d,]+(?:\.\d+)?)%", "资产负债率"),
]
AMOUNT_INDICATORS = ["营业收入", "净利润", "研发投入", "总资产"]
PERCENT_INDICATORS = ["净资产收益率", "毛利率", "资产负债率"]
UNIT_LOOKAHEAD = 5
# value and unit captured together
VALUE_WITH_UNIT_PATTERNS = [
    (r"(?:营业收入|营业总收入)[：\s]*?(\d[\d,.]+\s*(?:亿元|万元|元))", "营业收入"),
    (r"(?:归属于上市公司股东的净利润|归属于母公司所有者的净利润)[：\s]*?(\d[\d,.]+\s*(?:亿元|万元|元))", "净利润"),
    (r"(?:加权平均净资产收益率|净资产收益率)[：\s]*?(\d[\d,.]+\s*%)", "净资产收益率"),
    (r"(?:基本每股收益|每股收益)[：\s]*?(\d[\d,.]+\s*元)", "每股收益"),
    (r"毛利率[：\s]*?(\d[\d,.]+\s*%)", "毛利率"),
    (r"(?:研发投入|研发费用)[：\s]*?(\d[\d,.]+\s*(?:亿元|万元|元))", "研发投入"),
    (r"总资产[：\s]*?(\d[\d,.]+\s*(?:亿元|万元|元))", "总资产"),
    (r"资产负债率[：\s]*?(\d[\d,.]+\s*%)", "资产负债率"),
]
# every match; value and (where captured) unit are separate groups
ALL_VALUE_PATTERNS = [
    (r"(?:营业收入|营业总收入)[：:\s]*?([\d,]+(?:\.\d+)?)\s*(亿元|万元|元)", "营业收入"),
    (r"(?:归属于上市公司股东的净利润|归属于母公司所有者的净利润|净利润)[：:\s]*?([\d,]+(?:\.\d+)?)\s*(亿元|万元|元)", "净利润"),
    (r"(?:加权平均净资产收益率|净资产收益率|ROE)[：:\s]*?([\d,]+(?:\.\d+)?)\s*%", "净资产收益率"),
    (r"(?:基本每股收益|每股收益)[：:\s]*?([\d,]+(?:\.\d+)?)\s*元", "每股收益"),
    (r"毛利率[：:\s]*?([\d,]+(?:\.\d+)?)\s*%", "毛利率"),
    (r"(?:研发投入|研发费用)[：:\s]*?([\d,]+(?:\.\d+)?)\s*(亿元|万元|元)", "研发投入"),
    (r"总资产[：:\s]*?([\d,]+(?:\.\d+)?)\s*(亿元|万元|元)", "总资产"),
    (r"资产负债率[：:\s]*?([\d,]+(?:\.\d+)?)\s*%", "资产负债率"),
]
UNITS = ["亿元", "万元", "元", "%"]
INDICATOR_KEYWORDS = {
    "营业收入": ["营业收入", "营收"],
    "净利润": ["净利润", "净利", "归属于母公司"],
    "毛利率": ["毛利率"],
    "净资产收益率": ["净资产收益率", "ROE", "roe"],
    "每股收益": ["每股收益", "基本每股收益"],
    "研发投入": ["研发投入", "研发费用"],
    "资产负债率": ["资产负债率"],
    "总资产": ["总资产"],
    "经营活动现金流": ["经营活动产生", "经营性现金流"],
    "市盈率": ["市盈率"],
}
CONTEXT_KEYWORDS = {
    "营业收入": ["营业收入", "营业总收入"],
    "净利润": ["净利润", "归属于上市公司股东的净利润"],
    "毛利率": ["毛利率"],
    "净资产收益率": ["净资产收益率"],
    "每股收益": ["每股收益"],
    "研发投入": ["研发投入"],
    "总资产": ["总资产"],
    "资产负债率": ["资产负债率"],
    "经营活动现金流": ["经营活动产生的现金流量净额"],
}
CONTEXT_BEFORE = 5
CONTEXT_AFTER = 80
SUMMARY_KEYWORDS = [
    "行业发展", "行业政策", "市场趋势", "宏观", "监管政策", "行业格局",
    "行业调整", "行业竞争", "市场规模", "行业增速", "行业集中度",
    "政策变化", "政策环境", "行业面临", "机遇与挑战", "行业发展趋势",
    "市场情况", "行业概况",
]
SUMMARY_MIN_CHARS = 100
NARRATIVE_KEYWORDS = ["报告期内", "行业发展", "行业格局", "政策", "市场", "趋势", "公司实现", "同比增长"]
NARRATIVE_MIN_KEYWORDS = 3
NARRATIVE_MIN_CHARS = 300
EXCLUDED_SOURCE_PREFIX = "H3_"
COMPANY_BLOCKLIST = ["证券研究报告", "传媒", "半导体", "消费", "白酒"]
COMPANY_MIN_FILES = 3

# --- fixed values: evaluation --------------------------------------------------------------
HIT_CUTOFFS = [1, 3, 5, 10, 20, 50, 100, 200, 500]
RANK_BUCKETS = [(1, 1), (2, 5), (6, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, 500)]
TABLE_MATCH_LIMIT = 0.8
CHUNK_SIZES = [256, 512, 1024]
CHUNK_OVERLAPS = [50, 100, 200]

# --- fixed values: PDF acceptance ----------------------------------------------------------
PDF_MAGIC_HEX = "25504446"
PDF_MIN_BYTES = 10000

# --- fixed values: marks in whole-document texts and in Markdown output --------------------
PAGE_MARK = "\n--- 第 {page} 页 ---\n"
TABLE_MARK = "\n[表格]\n"
MARKDOWN_PAGE = " 第 {page} 页\n"
MARKDOWN_TABLE = "**表格 {number}**\n\n"
MARKDOWN_TEXTS = "文本内容"
MARKDOWN_TABLES = "表格"
MARKDOWN_RULE = "---\n"
