"""Fixed values of the model.

They must equal the published ones for results to agree: wage curves, age points, tables of names
and bounds.  They are stated as they are.
"""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------
AGE_POINTS = (22, 27, 32, 37, 42, 47, 52, 57, 62, 67)
TARGET_AGES = (25, 30, 35, 40, 45, 50, 55, 60)
PAGE_SIZE = 30
#: The anchor age of the two-point adjustment.
ANCHOR_AGE = 22
DEFAULT_AGE = 35
ALL_INDUSTRIES = "産業計"
#: Annual wages in thousand yen at the age points, all sizes.
WAGE_CURVES = {
    "産業計": (3351.3, 4140.7, 4634.9, 5129.7, 5475.7, 5748.2, 5986.7, 6052.7, 4616.4, 3777.2),
    "製造業": (3396.9, 4063.8, 4659.8, 5290.2, 5591.3, 5881.3, 6177.6, 6287.2, 4339.6, 3139.4),
    "金融業・保険業": (3418.9, 4878.1, 6050.5, 6976.9, 7671.6, 7876.2, 7840.6, 7586.6, 5147.5, 4631.0),
    "情報通信業": (3443.9, 4512.2, 5193.8, 6194.0, 6759.9, 7482.4, 7489.6, 8042.1, 5766.0, 3873.9),
    "サービス業": (3116.5, 3743.0, 4124.4, 4349.5, 4673.1, 4801.5, 5078.0, 5087.7, 3878.0, 3180.8),
}
#: Sectors of the exchange (33) and the wage survey's industry of each; others count as all industries.
SECTOR_INDUSTRY = {
    "食料品": "製造業", "繊維製品": "製造業", "パルプ・紙": "製造業", "化学": "製造業", "医薬品": "製造業",
    "石油・石炭製品": "製造業", "ゴム製品": "製造業", "ガラス・土石製品": "製造業", "鉄鋼": "製造業",
    "非鉄金属": "製造業", "金属製品": "製造業", "機械": "製造業", "電気機器": "製造業", "輸送用機器": "製造業",
    "精密機器": "製造業", "その他製品": "製造業",
    "陸運業": "運輸業", "海運業": "運輸業", "空運業": "運輸業", "倉庫・運輸関連業": "運輸業", "倉庫・運輸関連": "運輸業",
    "情報・通信業": "情報通信業", "卸売業": "卸売業・小売業", "小売業": "卸売業・小売業",
    "銀行業": "金融業・保険業", "証券、商品先物取引業": "金融業・保険業", "保険業": "金融業・保険業", "その他金融業": "金融業・保険業",
    "鉱業": "鉱業", "建設業": "建設業", "電気・ガス業": "電気・ガス業", "不動産業": "不動産業", "サービス業": "サービス業",
}
#: Histogram widths in units of 10,000 yen, and the number of bins.
BIN_LADDER = (10, 20, 25, 50, 100, 200, 250, 500, 1000)
BINS = 9
#: Milestones in units of 10,000 yen.
MILESTONES = (300, 400, 500, 600, 700, 800, 900, 1000, 1200, 1500, 2000, 2500, 3000)
#: Digit repair: lowest pay, highest pay of firms of 20 people and of smaller ones, factors tried.
REPAIR_FLOOR, REPAIR_CEILING, REPAIR_CEILING_SMALL, REPAIR_STAFF = 2_000_000, 30_000_000, 120_000_000, 20
REPAIR_FACTORS = (10, 100, 1000, 10_000)
#: Kernel regression: bandwidth in years, least points, ages.
FIT_BANDWIDTH, FIT_LEAST_POINTS, FIT_AGES = 3.0, 50, (26, 55)
# ------------------------------------------------------------------------------------------------
