"""Theme of a fund from the text of its index and name."""

from __future__ import annotations

from pyspark.sql import Column

from marketframe.functions.scalar import classify

# Ordered themes with their patterns; the first match counts.
THEMES = [
    ("semiconductor", "半导体|芯片|集成电路"),
    ("health", "医药|医疗|医械|创新药|生物|疫苗|中药|制药|药物|养老|健康"),
    ("new_energy", "新能源|电池|电动|光伏|风电|储能|氢能|锂|稀土|碳中和|碳能|碳达峰|清洁能源|绿色电力"),
    ("vehicle", "汽车|智能驾驶|车联网"),
    ("technology", "科技|信息|计算机|软件|互联网|通信|通讯|电子|5G|6G|人工智能|AI|云计算|数据|数字|智能|机器人|物联网|网络|信创|消费电子"),
    ("defense", "军工|国防|航空|航天|卫星|低空|通用航空"),
    ("finance", "银行|证券|券商|保险|金融|财富管理|金融科技"),
    ("consumption", "消费|食品|饮料|酒|家电|家居|家用|畜牧|养殖|农业|农牧|旅游|文旅|休闲|餐饮|零售|纺织|服装|商贸"),
    ("media", "传媒|游戏|影视|文化|娱乐|教育|出版|动漫|体育"),
    ("resources", "有色|金属|钢铁|煤炭|石油|石化|化工|油气|能源|矿业|材料|黄金股|资源|稀有|化纤"),
    ("infrastructure", "建筑|建材|基建|地产|房地产|工程|机械|制造|工业|装备|水泥|运输|交通|物流|电力|电网|公用|环保|水务|电气|港口|航运|交运"),
    ("dividend", "红利|股息"),
    ("value_quality", "低波|价值|质量|现金流|基本面"),
    ("growth", "成长|创新|新兴|创成长|硬科技|新质|科创综指"),
    ("ownership_esg", "央企|国企|国资|治理|ESG|责任|可持续|一带一路|改革|民企|民营"),
    ("regional", "长三角|湾区|京津冀|京津|成渝|浙江|江苏|山东|四川|湖北|上海国企|上海改革|北京50|浙江凤凰|粤港澳"),
]
# Fixed value: bonds, cash and physical commodities are no equity theme.
NO_THEME = "期货|债券|国债|政金债|信用债|城投债|短融|货币|现金添|现金宝|保证金|黄金ETF|黄金交易|黄金现货|白银"


def theme(text: Column) -> Column:
    return classify(text, THEMES, NO_THEME)
