"""The rule bank, the topic modules and the field registry, as plain data and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Field, description, confidence, pattern (Python syntax; case is ignored, ^ and $ are line ends).
BANK: list[tuple[str, str, float, str]] = [
    ("project_name", "标注项目名称-跨行", 0.95, r"项目名称[：:]\s*(.{5,120}?)(?:\n|项目编号|项目地点|项目单位|采购人)"),
    ("project_name", "标注项目名称", 0.90, r"项目名称[：:]\s*([^，。]{5,100})"),
    ("project_name", "标注工程名称", 0.95, r"工程名称[：:]\s*([^，。\n]{5,100})"),
    ("project_name", "招标项目名称", 0.90, r"招标项目[：:]\s*([^，。\n]{5,80})"),
    ("project_name", "标段名称", 0.85, r"标段名称[：:]\s*([^，。\n]{5,80})"),
    ("bid_amount", "大写金额-投标报价", 0.95, r"投标(?:总)?报价[：:]\s*(?:人民币)?[（(]?(?:大写)?[)）]?\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零]+(?:元[整]?)?)"),
    ("bid_amount", "数字金额-投标报价", 0.95, r"投标(?:总)?报价[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("bid_amount", "数字金额-投标金额", 0.95, r"投标金额[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("bid_amount", "大写金额-投标金额", 0.95, r"投标金额[：:]\s*(?:人民币)\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零]+(?:元[整]?)?)"),
    ("bid_amount", "括号数字金额", 0.90, r"投标金额[：:][^（(]*[（(][¥￥]?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*[)）]"),
    ("bid_amount", "合同/中标金额", 0.90, r"(?:合同|中标|成交)(?:金额|价[格款]?)[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("bid_amount", "预算/控制价", 0.85, r"(?:预算|控制价|限价)[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("bid_amount", "行内大写金额", 0.90, r"人民币[（(]大写[)）][：:]?\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零]+(?:元[整]?)?)"),
    ("bid_amount", "括号大写金额", 0.85, r"[（(]大写[)）][：:]?\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零]+(?:元[整]?)?)"),
    ("bid_amount", "¥符号金额", 0.85, r"[¥￥]\s*(\d[\d,]*(?:\.\d{1,2})?)"),
    ("bid_amount", "项目预算-万元", 0.90, r"(?:项目预算|预算金额|最高限价|招标控制价)[：:]\s*(\d[\d,]*(?:\.\d{1,4})?)\s*万元"),
    ("bid_amount", "项目预算-元", 0.90, r"(?:项目预算|预算金额|最高限价|招标控制价)[：:]\s*(\d[\d,]*(?:\.\d{1,2})?)\s*元"),
    ("bid_amount", "宽松-万元金额", 0.70, r"(\d[\d,]*(?:\.\d{1,4})?)\s*万元"),
    ("bid_amount", "宽松-元金额", 0.65, r"(\d[\d,]*(?:\.\d{1,2})?)\s*元(?:[整]|人民币)?"),
    ("deposit", "投标保证金-数字", 0.95, r"投标保证金[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("deposit", "投标保证金-大写", 0.95, r"投标保证金[：:]\s*(?:人民币)?[（(]?(?:大写)?[)）]?\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零]+(?:元[整]?)?)"),
    ("deposit", "履约保证金", 0.90, r"履约保证金[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("deposit", "质量/工程保证金", 0.85, r"(?:质量|工程)保证金[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("deposit", "通用保证金", 0.80, r"保证金[：:]\s*(?:人民币)?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元"),
    ("deposit", "大写保证金", 0.90, r"保证金[：:]\s*(?:人民币)\s*([壹贰叁肆伍陆柒捌玖拾佰仟万亿零]+(?:元[整]?)?)"),
    ("deposit", "括号数字保证金", 0.85, r"保证金[：:][^（(]*[（(][¥￥]?\s*(\d[\d,]*(?:\.\d{1,2})?)\s*[)）]"),
    ("bid_date", "投标截止日期", 0.95, r"投标(?:截止)?(?:日期|时间)[：:]\s*(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日(?:\s*\d{1,2}[：:]\d{2})?)"),
    ("bid_date", "开标日期", 0.95, r"开标(?:日期|时间)[：:]\s*(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日(?:\s*\d{1,2}[：:]\d{2})?)"),
    ("bid_date", "中文日期格式", 0.85, r"(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)"),
    ("bid_date", "ISO日期格式", 0.80, r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"),
    ("bid_date", "带时间的日期", 0.90, r"(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日\s*\d{1,2}\s*[时：:]\s*\d{2}\s*分?)"),
    ("contact_info", "标注手机号", 0.95, r"(?:手机|电话|联系电话|移动电话)[：:]\s*(1[3-9]\d{9})"),
    ("contact_info", "独立手机号", 0.70, r"(1[3-9]\d{9})"),
    ("contact_info", "标注座机号", 0.95, r"(?:电话|联系电话|办公电话|传真)[：:]\s*(0\d{2,3}[-\s]?\d{7,8})"),
    ("contact_info", "独立座机号", 0.70, r"(0\d{2,3}[-\s]?\d{7,8})"),
    ("contact_info", "标注邮箱", 0.95, r"(?:邮箱|电子邮[件箱]|E-?mail)[：:]\s*([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"),
    ("contact_info", "独立邮箱", 0.75, r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"),
    ("contact_info", "标注地址", 0.90, r"(?:地址|通讯地址|办公地址|注册地址)[：:]\s*([^，。\n]{10,80})"),
    ("contact_info", "邮编", 0.95, r"邮(?:政)?编(?:码)?[：:]\s*(\d{6})"),
    ("bidder", "投标人名称", 0.95, r"投标人[：:]\s*([^，。\n]{4,50}(?:有限公司|集团|公司|企业))"),
    ("bidder", "投标单位名称", 0.95, r"投标单位[：:]\s*([^，。\n]{4,50}(?:有限公司|集团|公司|企业))"),
    ("tenderer", "采购人/招标人", 0.95, r"(?:采购人|招标人|项目单位|建设单位)[^：:]*[：:]\s*([^，。\n]{4,50})"),
    ("tenderer", "采购/招标代理机构", 0.85, r"(?:采购代理|招标代理)[^：:]*[：:]\s*([^，。\n]{4,50})"),
    ("legal_representative", "法定代表人", 0.95, r"法定代表人[：:]\s*([一-龥]{2,4})"),
    ("legal_representative", "法人代表", 0.90, r"法人代表[：:]\s*([一-龥]{2,4})"),
    ("legal_representative", "项目经理", 0.95, r"项目(?:经理|负责人)[：:]\s*([一-龥]{2,4})"),
    ("legal_representative", "技术负责人", 0.90, r"技术负责人[：:]\s*([一-龥]{2,4})"),
    ("legal_representative", "联系人", 0.75, r"联系人[：:]\s*([一-龥]{2,4})"),
    ("legal_representative", "授权代表", 0.90, r"授权代表[：:]\s*([一-龥]{2,4})"),
    ("project_number", "项目编号", 0.95, r"项目编号[：:]\s*([A-Za-z0-9\-_/]{5,30})"),
    ("project_number", "招标编号", 0.95, r"招标编号[：:]\s*([A-Za-z0-9\-_/]{5,30})"),
    ("project_number", "标书编号", 0.90, r"标书编号[：:]\s*([A-Za-z0-9\-_/]{5,30})"),
    ("project_number", "合同编号", 0.85, r"合同编号[：:]\s*([A-Za-z0-9\-_/]{5,30})"),
    ("business_license", "统一社会信用代码", 0.95, r"(?:统一社会信用代码|信用代码)[：:]\s*([0-9A-Z]{18})"),
    ("business_license", "营业执照号", 0.95, r"营业执照[^：:]*[：:]\s*([0-9A-Z]{15,18})"),
    ("qualification_cert", "资质证书编号", 0.90, r"(?:资质|资格)证书[^：:]*编号[：:]\s*([A-Za-z0-9\-]{6,25})"),
    ("table_data", "表格-合计金额", 0.90, r"\|\s*(?:合计|总计|总价|报价)\s*\|\s*(\d[\d,]*(?:\.\d{1,2})?)\s*(?:万)?元?\s*\|"),
    ("table_data", "表格-金额列", 0.80, r"\|\s*[^|]*(?:金额|价格|报价|费用)\s*\|\s*(\d[\d,]*(?:\.\d{1,2})?)\s*\|"),
    ("table_data", "表格-日期列", 0.85, r"\|\s*[^|]*(?:日期|时间|期限)\s*\|\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2}[日]?)\s*\|"),
    ("table_data", "表格-人员列", 0.90, r"\|\s*(?:项目经理|负责人|法[人定]代表人?)\s*\|\s*([一-龥]{2,4})\s*\|"),
]

#: Fixed values of the overlay: labels that end a project name, and a date with an optional time.
NEXT_LABEL = r"项目编号(?:/包号)?|采购项目编号|招标编号|标段编号|项目地点|建设地点|项目单位|招标人|采购人|投标人|采购代理机构|代理机构|采购方式|预算金额|项目预算|最高限价"
DATE_TIME = r"20\d{2}\s*[-/年]\s*\d{1,2}\s*[-/月]\s*\d{1,2}\s*(?:日)?(?:\s*\d{1,2}\s*(?::|时)\s*\d{2}(?::\d{2})?)?"
#: Rules that go ahead of the bank's for their field.
AHEAD: list[tuple[str, str, float, str]] = [
    ("project_name", "PDF折行项目名称", 0.99, rf"项目名称[：:]\s*([^\r\n]{{5,120}}(?:\r?\n(?!\s*(?:{NEXT_LABEL})[：:])[^\r\n]{{2,120}}){{1,2}})(?=\r?\n\s*(?:{NEXT_LABEL})[：:])"),
    ("bid_date", "明确截止时间", 0.98, rf"(?:提交投标文件截止时间|提交响应文件截止时间|响应文件提交截止时间|投标文件递交截止时间|投标截止时间|截止/谈判时间|开标时间)[：:]?\s*({DATE_TIME})"),
    ("bid_date", "投标/开标动作时间", 0.98, rf"(?:投标人应于|本次招标将于)\s*({DATE_TIME})"),
    ("bid_date", "递交截止时间表格", 0.98, rf"(?:投标文件递交地点及递交截止时间|投标文件递交截止时间)[\s\S]{{0,160}}?时间[：:]\s*({DATE_TIME})"),
]
#: Descriptions that the strict bank leaves out: they belong to other roles than their field's.
LEFT_OUT = frozenset({"采购/招标代理机构", "项目经理", "技术负责人", "联系人", "授权代表"})

#: Module, name, priority, keywords, fields.
MODULES: list[tuple[str, str, int, str, str]] = [
    ("basic_info", "基础信息", 1, "项目名称 项目编号 招标编号 工程名称 项目概况 招标公告 招标范围 项目背景 建设地点 工程地点 项目地址 建设规模 工期 工期要求 计划工期 合同工期", "project_name project_number project_scope construction_site project_duration"),
    ("bidder_info", "投标人信息", 2, "投标人 投标单位 投标方 投标公司 招标人 招标单位 招标方 招标代理 法定代表人 法人代表 授权代表 联系人 联系电话 联系方式 通讯地址 传真 邮箱 邮编 地址", "bidder tenderer legal_representative contact_info address"),
    ("financial_info", "财务信息", 2, "投标报价 投标金额 投标总报价 报价 投标保证金 履约保证金 保证金 招标控制价 预算金额 项目金额 合同金额 人民币 万元 元整 大写 小写 金额 付款方式 付款条件 支付方式", "bid_amount deposit control_price budget_amount payment_terms"),
    ("qualification", "资格要求", 3, "资格条件 资质要求 投标人资格 营业执照 统一社会信用代码 注册资本 成立日期 经营范围 业务范围 资质证书 资格证书 等级证书 资质等级 施工资质 设计资质 安全生产许可证 质量管理体系 ISO 认证", "business_license registered_capital establishment_date business_scope qualification_cert"),
    ("evaluation", "评标办法", 4, "评标办法 评标方法 评审办法 评分标准 评标标准 评审标准 评分项 分值 权重 得分 技术评分 商务评分 综合评分 最低评标价 综合评估法 经评审的最低投标价法 评标委员会 评标专家", "evaluation_method scoring_criteria technical_score commercial_score"),
    ("submission", "投标递交", 3, "投标文件 递交 投标截止 开标时间 开标地点 投标截止时间 投标有效期 响应文件 递交截止 投标日期 投标时间", "bid_date bid_deadline opening_date validity_period"),
    ("personnel", "人员要求", 3, "项目经理 项目负责人 技术负责人 总工程师 安全员 质检员 施工员 造价师 拟派人员 主要人员 团队 人员配备 职称 资格证书 执业资格 建造师 工程师 技术员 身份证 证件号 学历 毕业 安全生产考核 安全B证 安全C证 注册证书 执业证书 从业资格 社保 社会保险", "project_manager technical_staff team_requirements personnel_info"),
    ("company_info", "企业信息", 5, "股东 持股比例 股权结构 实际控制人 子公司 关联公司 控股 参股 注册地址 公司地址 办公地址 银行账户 开户行 账号 财务状况 资产 负债", "shareholder_info subsidiary_info registered_address bank_account financial_info"),
    ("performance", "业绩记录", 5, "业绩 项目业绩 工程业绩 类似项目 类似工程 同类项目 合同业绩 中标业绩 施工业绩 业绩证明 竣工验收", "performance_record similar_projects"),
]


def bank(custom: dict[str, list] | None = None) -> list[tuple[str, int, str, float, str]]:
    """The active rules as (field, order, description, confidence, pattern), with custom ones after the built-in.

    A custom rule is a pattern or a dict with pattern, confidence (0.9; kept within 0 to 1) and
    description; it may name a new field. Patterns that don't compile are left out.
    """
    import re

    rules = [r for r in AHEAD + BANK if r[1] not in LEFT_OUT]
    for field, definitions in (custom or {}).items():
        for d in definitions if isinstance(definitions, list) else ():
            d = {"pattern": d} if isinstance(d, str) else d
            if isinstance(d, dict) and d.get("pattern"):
                rules.append((field, str(d.get("description") or "yaml-custom"), min(1.0, max(0.0, float(d.get("confidence", 0.9)))), str(d["pattern"])))
    out = []
    for i, (field, description, confidence, pattern) in enumerate(rules):
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append((field, i, description, confidence, pattern))
    return out


def rule_table(spark: SparkSession, custom: dict[str, list] | None = None) -> DataFrame:
    return spark.createDataFrame(bank(custom), "field_name string, rule_ord int, description string, confidence double, pattern string")


def module_table(spark: SparkSession) -> DataFrame:
    """module_id, module_name, priority, module_ord."""
    return spark.createDataFrame([(m, name, p, i) for i, (m, name, p, _, _) in enumerate(MODULES)], "module_id string, module_name string, priority int, module_ord int")


def keyword_rows() -> list[tuple[str, int, str, float]]:
    """(module, keyword order, keyword, weight): a hit counts a quarter a character, 3 at most, and up to a tenth more by priority."""
    return [(m, i, k, min(len(k) / 4, 3.0) * (1 + (10 - p) / 100)) for m, _, p, keys, _ in MODULES for i, k in enumerate(keys.split())]


def field_table(spark: SparkSession) -> DataFrame:
    """module_id, field_name, has_rules, llm_recoverable: a row per field of a module, and rule fields without one."""
    ruled = {r[0] for r in BANK}
    rows = [(m, f, f in ruled, f != "table_data") for m, *_, fields in MODULES for f in fields.split()]
    placed = {f for _, f, _, _ in rows}
    return spark.createDataFrame(rows + [(None, f, True, f != "table_data") for f in sorted(ruled - placed)], "module_id string, field_name string, has_rules boolean, llm_recoverable boolean")
