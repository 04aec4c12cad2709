"""Relations that a preposition and its noun's case stand for."""

# Preposition, case letter, relation.
TABLE = """
вроде g подобно
навроде g подобно
наподобие g подобно
подобно d подобно
сродни d подобно
а-ля n подобно
типа g подобно
сообразно d сообразно
соответственно d соответственно
без g без
безо g без
в a в__acc
во a в__acc
в l в__loc
во l в__loc
около g около
возле g около
подле g около
вблизи g около
близ g около
порядка g около
у g у
обок g обок
обочь g обок
вокруг g вокруг
вкруг g вокруг
округ g вокруг
кругом g вокруг
окрест g вокруг
благодаря d благодаря
ввиду g вследствие
вследствие g вследствие
исключая a исключая
выключая a исключая
внутри g внутри
внутрь g внутрь
вовнутрь g внутрь
вглубь g вглубь
вне g вне
снаружи g снаружи
накануне g накануне
вдоль g вдоль
вместо g вместо
замест g вместо
заместо g вместо
наместо g вместо
взамен g взамен
включая a включая
кончая i кончая
перед i перед
передо i перед
пред i перед
предо i перед
вперед g впереди
впереди g впереди
поперед g впереди
позади g позади
сзади g позади
назади g позади
после g после
опосля g после
позднее g после
спустя a спустя
вслед d вслед
вослед d вслед
вдогон d вдогон
для g для
ради g для
до g до
прежде g прежде
за a за__acc
за i за__ins
из g из
изо g из
из-под g из-под
из-подо g из-под
изнутри g изнутри
из-за g из-за
к d к
ко d к
навстречу d навстречу
мимо g мимо
на a на__acc
на l на__loc
назад a назад
наперерез d наперерез
наперехват d наперерез
о a о__acc
об a о__acc
обо a о__acc
о l о__loc
об l о__loc
обо l о__loc
касаемо g касаемо
касательно g касаемо
насчет g насчет
относительно g относительно
от g от
ото g от
по a по__acc
по d по__dat
по l по__loc
по-за a по-за__acc
по-за i по-за__ins
по-под i по-под
под a под__acc
подо a под__acc
под i под__ins
подо i под__ins
ниже g ниже
снизу g ниже
внизу g ниже
поперек g поперек
посредством g посредством
путем g посредством
при l при
про a про
напротив g напротив
насупротив g напротив
против g против
противу g против
супротив g против
вопреки d вопреки
наперекор d вопреки
противно d вопреки
вразрез d вопреки
с g с__gen
со g с__gen
с a с__acc
со a с__acc
с i с__ins
со i с__ins
кроме g кроме
окроме g кроме
окромя g кроме
опричь g кроме
помимо g помимо
сверх g сверх
свыше g сверх
над i над
надо i над
выше g выше
превыше g превыше
вверху g вверху
наверху g вверху
сверху g вверху
поверх g поверх
посверху g поверх
сквозь a сквозь
скрозь a сквозь
согласно d согласно
согласно g согласно
среди g среди
средь g среди
середи g среди
середь g среди
посередине g посередине
посередке g посередине
посередь g посередине
посреди g посередине
осредине g посередине
меж i между__ins
между i между__ins
промеж i между__ins
промежду i между__ins
меж g между__gen
между g между__gen
промеж g между__gen
промежду g между__gen
через a через
черезо a через
чрез a через
"""
RELATION = {(p, case): relation for p, case, relation in map(str.split, TABLE.split("\n")[1:-1])}
