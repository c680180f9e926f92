"""Word lists of the Russian catalog domain; every function takes its own list as a parameter instead."""

# Keywords by category, in the order in which categories are tried.
CATEGORIES = {
    "инструмент": "лопата монтировка молоток отвертка ключ ножницы пила дрель шуруповерт шуп пробоотборник".split(),
    "медикаменты": "энрофлоксацин колистин антибиотик витамин лекарство медикамент препарат медицинский".split(),
    "стройматериалы": "труба панель коробка кабель провод кран смеситель раковина унитаз шуруп винт болт гвоздь".split(),
    "электроника": ["телефон", "роутер", "маршрутизатор", "точка доступа", "кабель", "адаптер", "модем", "компьютер", "ноутбук", "сотовый"],
    "оборудование": "конвейер мельница котел вентилятор дождеватель насос компрессор генератор бункер уловитель".split(),
    "расходники": "салфетка добавка топливопровод полиэтилен пленка скотч клей лента бумага наждачная".split(),
    "автоаксессуары": ["коврик", "чехол", "зеркало", "фара", "задней четвертины", "филе", "бедрышки", "маринованные"],
    "канцелярия": ["маркер", "ручка", "карандаш", "ластик", "степлер", "скрепка", "бумага", "наждачная бумага", "спрей для чистки маркерной"],
    "средства очистки": "спрей дезинфицирующая моющее чистка дезинфекция".split(),
    "продукты": "маринованные соленые копченые колбаса сыр молоко хлеб филе бедрышки".split(),
    "сельское хозяйство": ["кормовая", "добавка кормовая", "удобрение", "пестицид", "инсектицид", "корм"],
    "связь": "телефон сотовый nokia роутер маршрутизатор".split(),
    "сантехника": "смеситель раковина унитаз ванна душ труба шланг кран".split(),
    "мебель": "стол стул кровать шкаф полка тумба".split(),
    "инструменты измерительные": ["мегаомметр", "мультиметр", "вольтметр", "амперметр", "тахометр", "стандарт мутности"],
    "программное обеспечение": ["резервное копирование", "программа", "приложение", "софт"],
    "упаковка": "полиэтилен пакет коробка контейнер бутылка банка упаковка".split(),
}
OTHER = "другое"

# Stems that confirm a category when its confidence is scored.
CONFIRMING = {
    "инструмент": "молот отвер ключ пила дрель шуруп".split(),
    "медикаменты": "лекарств препарат таблет мазь сироп".split(),
    "стройматериалы": "цемент кирпич блок панель плита".split(),
    "электроника": "компьютер телефон планшет монитор принтер".split(),
    "оборудование": "станок агрегат установ машин".split(),
    "канцелярия": "ручк карандаш тетрад папк скреп".split(),
    "автоаксессуары": "автомобиль авто машин колес шин".split(),
    "средства очистки": "мыло моющ чист порош".split(),
    "продукты": "хлеб молок мяс рыб овощ".split(),
    "сельское хозяйство": "семен удобр корм сельхоз".split(),
    "связь": "телефон роутер модем антенн".split(),
    "сантехника": "кран труб смесител унитаз".split(),
    "мебель": "стол стул шкаф диван кресл".split(),
    "инструменты измерительные": "измер метр линейк уровень".split(),
}

# Units glued to a number and units after a space, in matching order.
UNITS_GLUED = "mm|cm|m|kg|g|l|ml|w|a|v|watt|kw|h|min|sec|см|мм|м|л|кг|г|мг|шт|мл|в|а|вт|квт|ч|мин|сек"
UNITS_SPACED = "см|мм|м|л|кг|%|г|мг|шт|мл|в|а|вт|квт|ч|мин|сек|mm|cm|m|kg|g|l|ml|w|a|v|watt|kw|h|min|sec"
#: What a unit measures; the first list that has it decides.
UNIT_MEANING = {
    "thickness": "mm мм cm см m м".split(),
    "weight": "kg кг g г мг".split(),
    "volume": "l л ml мл".split(),
    "power": "w в watt kw квт вт".split(),
    "electrical": "v a а".split(),
    "duration": "h ч min мин sec сек".split(),
    "quantity": ["шт"],
    "percentage": ["%"],
}

# Stop words of the three tokenizers.
STOP_NAMES = "и в на с для по из к от о а но или то что".split()
STOP_TABLE = "и в на для с по от до из к о об а но или если что".split()
STOP_KEYWORDS = "и в на с для по из к от".split()

#: Letters that sound alike, folded one to one.
SOUND_FROM, SOUND_TO = "еёйобвгджз", "иииапфктшс"

#: Latin spelling of Cyrillic letters.
LATIN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e yo zh z i y k l m n o p r s t u f h ts ch sh shch _ y _ e yu ya".split(), strict=True)) | {"ъ": "", "ь": ""}

# Brands that a name may carry.
BRANDS = (
    "Samsung Apple LG Bosch Sony Philips Siemens Panasonic Xiaomi Huawei Lenovo HP Dell Asus Acer MSI Gigabyte Intel AMD Nvidia Canon Nikon "
    "Olympus Fujifilm Whirlpool Electrolux Indesit Ariston Gorenje Candy Zanussi Beko Hotpoint Miele Liebherr AEG Neff Kuppersberg Haier "
    "Hisense TCL Sharp Toshiba Hitachi JVC Pioneer Grundig Vestel Midea Artel Shivaki Atlant Pozis Норд Бирюса Саратов Свияга Microsoft "
    "Google Motorola Nokia OnePlus Oppo Vivo Realme Honor Redmi Poco Tesla Makita DeWalt Metabo Stanley Black+Decker Ryobi Einhell"
).split()

# Signs of goods and of services.
PRODUCT_SIGNS = [
    r"\b(кабель|провод|шнур|жгут)\b", r"\b(датчик|преобразователь|измеритель|сенсор)\b", r"\b(фасонные\s+элементы?|комплектующие|запчасти)\b",
    r"\b(панель|плита|лист|блок|кирпич)\b", r"\b(оборудование|аппарат|прибор|устройство|механизм)\b", r"\b(материал|изделие|продукция|товар)\b",
    r"\b(артикул|арт\.?|art\.?|модель|марка|тип)\s*[:\-]?\s*[a-zA-Z0-9]+\b", r"\b(размер|диаметр|длина|ширина|высота|толщина|вес)\s*[:\-]?\s*[\d.,xх]+\b",
    r"\b(ral|din|iso|gost|гост)\s*[a-zA-Z0-9]+\b", r"\b\d+\s*(мм|см|м|кг|г|л|мл|шт|шт\.|штук)\b",
]
SERVICE_SIGNS = [
    r"\b(услуг[аи]|услуги|услуг)\b", r"\b(работ[аы]|работа|работ)\b", r"\b(выполнение|оказание|предоставление)\s+(услуг|работ)\b",
    r"\b(монтаж|установка|демонтаж|сборка|разборка)\b", r"\b(ремонт|обслуживание|техобслуживание|настройка)\b",
    r"\b(испытание|тестирование|проверка|контроль|аудит|экспертиза)\b", r"\b(консультация|консультирование|совет|помощь|поддержка)\b",
    r"\b(обучение|тренинг|курс|семинар)\b", r"\b(доставка|транспортировка|перевозка|грузоперевозка|логистика)\b",
    r"\b(проектирование|проект|разработка|дизайн|планирование)\b", r"\b(строительство|строительные\s+работы|отделочные\s+работы|ремонтные\s+работы)\b",
]
PRODUCT_TRAITS = [
    r"\b\d+\s*(мм|см|м|кг|г|л|мл|шт)\b", r"\b\d+[xх]\d+", r"\b\d+[.,]\d+\s*(мм|см|м|кг|г)\b", r"\b(арт\.?|art\.?|№)\s*[a-zA-Z0-9.-]+\b",
    r"\b(ral|din|iso|gost|гост)\s*[a-zA-Z0-9]+\b", r"\b(марка|модель|тип|серия)\s*[:\-]?\s*[a-zA-Z0-9]+\b", r"\b[a-zA-Z]{2,}\d+\b",
]
PRODUCT_WORDS = (
    "кабель датчик преобразователь элемент панель оборудование материал изделие марка модель размер диаметр длина ширина высота вес толщина артикул "
    "болт винт гайка шайба саморез муфта тройник фильтр редуктор подшипник клапан насос двигатель трансформатор автомат выключатель розетка вилка "
    "разъем коннектор провод шнур жгут лента пленка лист плита блок кирпич бетон цемент песок щебень арматура профиль труба швеллер уголок балка "
    "рейка доска брус бревно краска лак грунтовка шпаклевка герметик клей мастика изоляция утеплитель пароизоляция гидроизоляция фанера дсп двп осб "
    "мдф металл сталь алюминий медь пластик полиэтилен полипропилен резина силикон текстиль ткань фасонные комплектующие запчасти компонент деталь "
    "узел блок модуль система комплект набор"
).split()
SERVICE_WORDS = (
    "услуга услуги работы работа выполнение оказание предоставление монтаж установка демонтаж сборка разборка ремонт обслуживание техобслуживание "
    "настройка регулировка калибровка поверка аттестация сертификация испытание тестирование проверка контроль аудит экспертиза консультация "
    "консультирование совет помощь поддержка обучение тренинг доставка транспортировка перевозка грузоперевозка логистика складирование хранение "
    "упаковка фасовка маркировка проектирование проект разработка дизайн планирование проектирование строительство"
).split() + ["строительные работы", "отделочные работы", "ремонтные работы", "монтажные работы", "пусконаладочные работы", "наладка", "пусконаладка", "ввод в эксплуатацию"]
#: What a name shouldn't hold any more, and what is taken out of it.
SUSPICIOUS = ["арт.", "арт:", "артикул", "код:", "код "]
SUSPICIOUS_REMOVED = ["арт.", "арт:", "артикул", "код:"]
