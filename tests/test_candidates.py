"""Search results against retailer rules; expected decisions derived by hand from the reference rules."""

import pytest

from offerscope.operators.candidates import RULES, accept_candidates

S25, U25, PHONE17 = ("Samsung", "Samsung Galaxy S25", "mobile"), ("Samsung", "Samsung Galaxy S25 Ultra", "mobile"), ("Apple", "Apple iPhone 17 Pro", "mobile")
FLIP, TAB, BOOK = ("Samsung", "Samsung Galaxy Z Flip7", "mobile"), ("Samsung", "Samsung Galaxy Tab S10 WiFi", "tablet"), ("Samsung", "Samsung Galaxy Book5 Pro 16", "laptop")
IPAD, AIR = ("Apple", "Apple iPad Air M3 11 WiFi", "tablet"), ("Apple", "Apple MacBook Air 13 M4", "laptop")
AMAZON, GROVER, MEDIA = "https://www.amazon.es/x/dp/B0ABCDEF12", "https://www.grover.com/es-es/products/x", "https://www.mediamarkt.es/es/product/x-1.html"
RENTIK, FNAC, PCC = "https://rentik.com/ofertas-alquilar/samsung/galaxy-x", "https://www.fnac.es/Samsung-Galaxy/a123", "https://www.pccomponentes.com/samsung-galaxy-x"
CASES = [
    ("Amazon", S25, 256, "", "Samsung Galaxy S25 256GB", AMAZON, True), ("Amazon", S25, 256, "", "Samsung Galaxy S25 512GB", AMAZON, False),
    ("Amazon", S25, 256, "", "Samsung Galaxy S25 256GB", "https://www.amazon.es/s?k=s25", False), ("Amazon", S25, 256, "", "Samsung Galaxy S25 256GB", "https://notshop.es/x?amazon.es/dp/B0ABCDEF12", False),
    ("Amazon", S25, 256, "", "Samsung Galaxy S25 Edge 256GB", AMAZON, False), ("Amazon", S25, 256, "", "Samsung Galaxy S25+ 256GB", AMAZON, False),
    ("Amazon", S25, 256, "", "Samsung Galaxy S25 usado", AMAZON, False), ("Amazon", S25, 256, "", "Funda Samsung Galaxy S25", AMAZON, False),
    ("Amazon", S25, None, "", "Samsung Galaxy S 25 512GB", AMAZON, True), ("Amazon", FLIP, None, "", "Samsung Galaxy Z Flip 7", AMAZON, True), ("Amazon", FLIP, None, "", "Samsung Galaxy Z Flip 6 7 pulgadas", AMAZON, False),
    ("Amazon", PHONE17, 256, "", "Apple iPhone 17 Pro 256 GB", AMAZON, True), ("Amazon", PHONE17, 256, "", "iPhone 17 Pro 256 GB", AMAZON, False), ("Amazon", PHONE17, 256, "", "Apple iPhone 17 256 GB", AMAZON, False),
    ("Amazon", IPAD, 128, "", "Apple iPad Air 11 M3 128 GB", AMAZON, True), ("Amazon", BOOK, None, "NP960XHA-KG1ES", "Samsung NP960XHA portatil", AMAZON, True),
    ("Amazon", BOOK, None, "", "Samsung Galaxy Book5 Pro portatil 16", AMAZON, True), ("Amazon", BOOK, None, "", "Samsung Galaxy Book4 Pro portatil 16 5", AMAZON, False),
    ("Grover", S25, 256, "", "Samsung Galaxy S25 256 GB", GROVER, True), ("Grover", S25, 256, "", "Samsung Galaxy S25 1 TB", GROVER, True), ("Grover", S25, 256, "", "Samsung Galaxy S25 FE", GROVER, False),
    ("Grover", S25, 256, "", "Samsung Galaxy S25", "https://www.grover.com/es-es/blog/s25", False), ("Grover", U25, 256, "", "Samsung Galaxy S25 Ultra 512 GB", GROVER, False), ("Grover", U25, 512, "", "Samsung Galaxy S25 Ultra 512 GB", GROVER, True),
    ("Grover", AIR, 256, "", "Apple MacBook Air 13", GROVER, True), ("Grover", AIR, 256, "", "Apple MacBook Pro 13", GROVER, False), ("Grover", IPAD, 128, "", "iPad Air", GROVER, True),
    ("Movistar", S25, 256, "", "Samsung Galaxy S25 512GB", "https://www.movistar.es/moviles/x", True), ("Movistar", S25, 256, "", "Samsung Galaxy S25", "https://www.movistar.es/x", False),
    ("Movistar", S25, 256, "", "Samsung Galaxy S25", "https://www.movistar.es/moviles/pack-ahorro-x", False), ("Movistar", TAB, 128, "", "Samsung Galaxy Tab S10 WiFi", "https://www.movistar.es/tablets/x", True),
    ("Movistar", U25, 256, "", "Samsung Galaxy S25", "https://www.movistar.es/moviles/x", False), ("Movistar detail", S25, 256, "", "Galaxy s25 Enterprise Edition", "https://www.movistar.es/moviles/x", True),
    ("Movistar detail", S25, 256, "", "Galaxy s24 Enterprise Edition", "https://www.movistar.es/moviles/x", False), ("Movistar detail", PHONE17, 256, "", "iPhone", "https://www.movistar.es/moviles/x", True),
    ("Media Markt", S25, 256, "", "Samsung Galaxy S25 512 GB", MEDIA, True), ("Media Markt", S25, 256, "", "Samsung Galaxy S24 25 W", MEDIA, False), ("Media Markt", TAB, 128, "", "Tablet Samsung Galaxy Tab S10 5G", MEDIA, False),
    ("Media Markt", TAB, 128, "", "Tablet Samsung Galaxy Tab S10 WiFi", MEDIA, True), ("Media Markt", BOOK, None, "", "Portatil Samsung Galaxy Book5 Pro 16 Core Ultra 7 teclado", MEDIA, True),
    ("Media Markt", BOOK, None, "", "Portatil Samsung Galaxy Book5 Pro 14 Core Ultra 7", MEDIA, False), ("Media Markt", ("Samsung", "Samsung Galaxy A16 5G", "mobile"), 128, "", "Samsung Galaxy A16 LTE 5 MP", MEDIA, False),
    ("Rentik", S25, 256, "", "Galaxy S25", RENTIK, True), ("Rentik", S25, 256, "", "Galaxy S25", "https://rentik.com/ofertas-alquilar/samsung/", False), ("Rentik", PHONE17, 256, "", "iPhone 17 Pro", "https://rentik.com/ofertas-alquilar/iphone/17-pro", True),
    ("Rentik", PHONE17, 256, "", "iPhone 17 Pro", RENTIK, False), ("Rentik", S25, 256, "", "Galaxy S25 gaming", "https://rentik.com/ofertas-alquilar/samsung/gaming", False),
    ("Fnac", S25, 256, "", "Samsung Galaxy S25", FNAC, True), ("Fnac", S25, 256, "", "Samsung Galaxy S25", "https://www.fnac.es/Samsung", False), ("Fnac", S25, 256, "", "Samsung Galaxy S25 Ultra", FNAC, False), ("Fnac", PHONE17, 256, "", "iPhone 17 Pro", FNAC.replace("Samsung-Galaxy", "x"), False),
    ("PcComponentes", S25, 256, "", "Samsung Galaxy S25 Ultra", PCC, True), ("PcComponentes", S25, 256, "", "Samsung Galaxy S25", PCC + "/x", False), ("PcComponentes", S25, 256, "", "Samsung Galaxy S25", PCC + "?offer=1", False),
    ("PcComponentes", S25, 256, "", "Samsung Galaxy S24", PCC, False), ("PcComponentes", S25, 256, "", "Cargador Samsung 25W", PCC, False),
    ("Apple Oficial", PHONE17, 256, "", "iPhone 17 Pro", "https://www.apple.com/es/shop/buy-iphone/iphone-17-pro", True), ("Apple Oficial", PHONE17, 256, "", "iPhone 17", "https://www.apple.com/es/shop/buy-iphone/iphone-17", False),
    ("Apple Oficial", ("Apple", "Apple iPhone 17", "mobile"), 256, "", "iPhone 17", "https://www.apple.com/es/shop/buy-iphone/iphone-17-pro", False), ("Apple Oficial", ("Apple", "Apple iPhone Air", "mobile"), 256, "", "iPhone Air", "https://www.apple.com/es/shop/buy-iphone/iphone-air", True),
    ("Apple Oficial", IPAD, 128, "", "iPad Air", "https://www.apple.com/es/shop/buy-ipad/ipad-air", True), ("Apple Oficial", AIR, 256, "", "MacBook Air", "https://www.apple.com/es/shop/buy-mac/macbook-air", True),
    ("Apple Oficial", S25, 256, "", "Samsung Galaxy S25", "https://www.apple.com/es/shop/buy-iphone/x", False),
    ("Samsung Oficial", S25, 256, "", "Galaxy S25", "https://www.samsung.com/es/smartphones/galaxy-s25/buy/", True), ("Samsung Oficial", S25, 256, "", "Galaxy S25", "https://www.samsung.com/es/smartphones/galaxy-s25-ultra/buy/", False),
    ("Samsung Oficial", U25, 256, "", "Galaxy S25", "https://www.samsung.com/es/smartphones/galaxy-s25/buy/", False), ("Samsung Oficial", S25, 256, "", "Galaxy S25", "https://www.samsung.com/es/smartphones/galaxy-s25-5g/buy/", False),
    ("Samsung Oficial", S25, 256, "", "Galaxy S25", "https://www.samsung.com/es/smartphones/galaxy-s25/", False), ("Samsung Oficial", TAB, 128, "", "Galaxy Tab S10 WiFi", "https://www.samsung.com/es/tablets/galaxy-tab-s10/buy/", True),
    ("Unknown", S25, 256, "", "Samsung Galaxy S25", AMAZON, False),
]
SCHEMA = "retailer string, brand string, model string, device_type string, capacity_gb int, product_code string, text string, href string, title string, body string, want boolean"


def rows(spark, cases):
    return spark.createDataFrame([(r, *p, size, code, text, href, None, "17 Pro 256 GB", want) for r, p, size, code, text, href, want in cases], SCHEMA)


def test_rules(spark):
    got = accept_candidates(rows(spark, CASES)).collect()
    assert [(r.retailer, r.model, r.text, r.href) for r in got if r.accepted != r.want] == []
    assert {c[0] for c in CASES if c[-1]} == set(RULES), "every rule accepts something"


def test_nulls_decide_against(spark):
    empty = spark.createDataFrame([(name, *[None] * 9) for name in [*RULES, None]], SCHEMA.replace(", want boolean", ""))
    got = accept_candidates(empty)
    assert got.columns == [*empty.columns, "accepted"] and not any(r.accepted for r in got.collect())


@pytest.mark.parametrize("bytes_", [100_000])
def test_plan_is_small(spark, bytes_):
    decided = accept_candidates(rows(spark, CASES))
    for df in (decided, decided.where("accepted")):
        plan = df._jdf.queryExecution().toString()
        assert len(plan[plan.index("== Physical Plan =="):]) < bytes_
    assert decided.where("accepted").count() == sum(c[-1] for c in CASES)
